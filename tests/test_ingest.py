import json

import pytest
from pyspark.sql import functions as F

from wardline.operators import identity as I
from wardline.sources import events as E


def lines(spark, *objs):
    rows = [(i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objs)]
    return spark.createDataFrame(rows, "line_no bigint, text string")


CLOUD = {
    "eventTime": "2026-09-07T14:20:58.123456789Z",
    "eventName": "ConsoleLogin",
    "sourceIPAddress": "203.0.113.44",
    "userIdentity": {"type": "IAMUser", "arn": "arn:x", "userName": "jdoe"},
    "responseElements": {"ConsoleLogin": "Success", "n": [1, None, True]},
}


def test_normalises_nested_fields_and_keeps_nanoseconds(spark):
    good, bad = E.normalize(lines(spark, CLOUD), E.CLOUD_AUDIT)
    out = json.loads(good.first().payload)
    assert bad.count() == 0
    assert out["actor"]["user"] == {"uid": "arn:x", "name": "jdoe"}
    assert out["time"] == 1788790858123456789
    assert out["unmapped"] == {"responseElements": {"ConsoleLogin": "Success", "n": [1, None, True]}}
    assert out["source_id"] == "aws-cloudtrail" and "cloud" not in out


def test_explicit_null_is_kept_and_offsets_are_applied(spark):
    ev = {"eventName": None, "eventTime": "2026-09-07T16:20:58+02:00"}
    out = json.loads(E.normalize(lines(spark, ev), E.CLOUD_AUDIT)[0].first().payload)
    assert out["event_name"] is None and out["time"] == 1788790858000000000


@pytest.mark.parametrize(
    "obj,reason",
    [
        ({"eventName": 5}, "untyped_number"),
        ({"eventName": {"a": "b"}}, "unsupported_value"),
        ({"eventTime": "yesterday"}, "bad_timestamp"),
        ({"eventTime": 5}, "bad_timestamp"),
        ({"x": 1.5}, "not_int64"),
        ({"x": 1.0}, "not_int64"),
        ({"x": 9223372036854775808}, "not_int64"),
        ([1, 2], "not_an_object"),
        ('{"a": 1, "a": 2}', "not_an_object"),
        ("nope", "not_an_object"),
    ],
)
def test_rejects(spark, obj, reason):
    good, bad = E.normalize(lines(spark, obj), E.CLOUD_AUDIT)
    assert good.count() == 0 and bad.first().reason == reason


def test_numbers_inside_strings_are_fine(spark):
    good, bad = E.normalize(lines(spark, {"note": 'v1.5 "x" -2e9', "x": -9223372036854775808}), E.CLOUD_AUDIT)
    assert bad.count() == 0 and json.loads(good.first().payload)["unmapped"]["x"] == -(2**63)


def test_int_field_needs_a_json_number(spark):
    bad = E.normalize(lines(spark, {"status": {"errorCode": "7"}}), E.SIGN_IN)[1]
    assert bad.first().reason == "not_int64"


def test_replay_is_repeatable_and_version_changes_ids(spark):
    import dataclasses

    corpus = lines(spark, CLOUD, "  ", CLOUD, {"eventName": "x"})
    ids, store, _ = E.replay_corpus(corpus, E.CLOUD_AUDIT)
    again, _, _ = E.replay_corpus(corpus.repartition(3), E.CLOUD_AUDIT)
    first = [r.evidence_id for r in ids.orderBy("line_no").collect()]
    assert first == [r.evidence_id for r in again.orderBy("line_no").collect()]
    assert len(first) == 3 and store.count() == 2
    newer, _, _ = E.replay_corpus(corpus, dataclasses.replace(E.CLOUD_AUDIT, mapping_version="2"))
    assert not set(first) & {r.evidence_id for r in newer.collect()}


def test_key_order_and_spacing_do_not_change_the_id(spark):
    a = '{"a":{"x":1,"y":[1,{"q":null,"p":"é"}]},"b":true}'
    b = '{ "b" : true, "a" : {"y":[1, {"p":"\\u00e9","q":null}], "x":1} }'
    c = '{"a":{"x":1,"y":[1,{"q":null,"p":"é"}]},"b":false}'
    ids = [r.evidence_id for r in I.with_evidence_id(lines(spark, a, b, c)).orderBy("line_no").collect()]
    assert ids[0] == ids[1] != ids[2]


def test_flatten_takes_the_union_of_columns(spark):
    df = E.parse_lines(lines(spark, {"a": {"b": 1}}, {"a": {"c": "x"}, "d": True})).select("line_no", "event")
    out = E.flatten_events(df).orderBy("line_no")
    assert out.columns == ["line_no", "a_b", "a_c", "d"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, None, None), (None, "x", True)]


def test_stream_reader_parses_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a":1}\n\nbad\n')
    stream = E.read_events(spark, str(tmp_path / "in"), streaming=True)
    q = stream.select("text", F.col("event").isNotNull().alias("ok")).writeStream.format("memory").queryName("lines_in").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.text, r.ok) for r in spark.sql("select * from lines_in").collect()} == {('{"a":1}', True), ("bad", False)}


def test_flatten_keeps_awkward_names(spark):
    df = E.parse_lines(lines(spark, {"VOID_REASON": "x", "it's": {"a b": 1}, "d.e": None}, {"OBJECT<": {"x`y": 2}, "VOID_REASON": "y"}))
    out = E.flatten_events(df.select("line_no", "event")).orderBy("line_no")
    assert out.columns == ["line_no", "OBJECT<_x`y", "VOID_REASON", "d.e", "it's_a b"]
    assert [tuple(r)[1:] for r in out.collect()] == [(None, "x", None, 1), (2, "y", None, None)]


def test_times_out_of_range_are_rejected(spark):
    stamps = ["0001-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "2262-04-11T23:47:16.854775807Z", "2024-01-01T00:00:00Z"]
    good, bad = E.normalize(lines(spark, *({"userId": "u", "createdDateTime": s} for s in stamps)), E.SIGN_IN)
    assert [r.reason for r in bad.collect()] == ["bad_timestamp"] * 2
    assert good.count() == 2


def test_rest_of_a_partly_mapped_object_is_kept(spark):
    import dataclasses

    by_path = dataclasses.replace(E.CLOUD_AUDIT, unmapped_paths=True)

    def unmapped(obj, mapping=by_path):
        return json.loads(E.normalize(lines(spark, obj), mapping)[0].first().payload).get("unmapped")

    assert unmapped(CLOUD) == {"responseElements": {"ConsoleLogin": "Success", "n": [1, None, True]}, "userIdentity": {"type": "IAMUser"}}
    assert unmapped({"userIdentity": {"arn": "a"}}) is None and unmapped({"eventName": "x"}) is None
    assert unmapped({"userIdentity": "a \"plain\" text}", "a b": {}}) == {"userIdentity": 'a "plain" text}', "a b": {}}
    assert unmapped({"userIdentity": {"arn": None, "x": {"arn": 1}}, "eventName": None}) == {"userIdentity": {"x": {"arn": 1}}}
    assert unmapped({"userIdentity": None, "q": "}"}) == {"userIdentity": None, "q": "}"}
    deep = dataclasses.replace(by_path, fields={"u": E.FieldMap("a.b.c"), "v": E.FieldMap("a.b.d"), "w": E.FieldMap("e"), "x": E.FieldMap("e.f")})
    assert unmapped({"a": {"b": {"c": "1", "z": 2}, "y": [3]}, "e": "4"}, deep) == {"a": {"b": {"z": 2}, "y": [3]}}
    assert unmapped({"a": {"b": {"c": "1", "d": "2"}}, "g": 5}, deep) == {"g": 5}
