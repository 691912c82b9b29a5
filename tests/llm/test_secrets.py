import hashlib
import random
import re
from collections import defaultdict

from tests.llm.helpers import DOCUMENTS, awkward, nothing
from wardline.llm import secrets

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base(text):
    """kind, start, end, start of the value"""
    out = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end(), m.start()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end(), m.start()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def live(value):
    mixed = re.search("[0-9]", value) and re.search("[A-Za-z]", value)
    return bool(mixed and len(set(value)) >= 8 and not re.search(secrets.MADE_UP, value))


def brute(rows):
    owners, found = defaultdict(set), []
    for doc_id, text, owner in rows:
        text = text or ""
        spans = base(text)
        values = {(at, end) for _, _, end, at in spans} | {m.span() for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text)}
        values = {(s, e) for s, e in values if e - s >= 16}
        for s, e in values:
            owners[text[s:e]].add(owner or "")
        found.append((doc_id, text, spans, values))
    out, kinds = [], ["assign", "access", "hex", "copied", "live"]
    for doc_id, text, spans, values in found:
        listed = sorted((s, kinds.index(k), e) for k, s, e, _ in spans)
        more = list(listed)
        for s, e in values:
            if len(owners[text[s:e]]) >= 3:
                more.append((s, 3, e))
            elif live(text[s:e]):
                more.append((s, 4, e))

        def say(items):
            return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(items))

        n = [sum(k == i for _, k, _ in more) for i in range(5)]
        out.append((doc_id, *n[:3], hashlib.sha256(say(listed).encode()).hexdigest(), say(more), *n[3:]))
    return sorted(out, key=repr)


def check(docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    found = secrets.scan(docs)
    assert found.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_against_brute_force(spark):
    rng = random.Random(3)
    shared, own = "".join(rng.choices("0123456789abcdef", k=40)), "AKIA" + "".join(rng.choices("ABCDEFGH01234567", k=16))
    texts = [
        f'token = "{shared}"',
        f"tOkEn:{shared} x",
        f"PASSWORD='{shared}'{own}",
        f"😀é {own} secret=token: abcdefgh password = abc passwd=abcdef",
        f"😀😀 {own}AKIA{own} api_key=\"{'Q7' * 9}ab12cdEF\" apikey:EXAMPLEexample0123456789",
        "AKIA1234 " + "f" * 23 + " " + "f" * 24 + "g" + "0" * 30,
        "token=" * 5 + "token = = x",
        "secret" + " " * 500 + "=" + " " * 500 + "abc/def+ghi==" + "-" * 25,
        "aB3" * 10 + ".com/" + "zZ9_" * 8,
        ("token=" + shared + "\n") * 300 + own,
        "K" + "toKen=abcdefgh ſecret=abcdefgh",
    ]
    rows = [(i, texts[i % len(texts)] + (" " * (i % 3)), None, None if i % 7 == 0 else f"s{i % 4}", 0) for i in range(60)]
    check(spark.createDataFrame(rows, DOCUMENTS))


def test_awkward_rows(spark):
    check(awkward(spark))
    assert secrets.scan(nothing(spark)).collect() == []


def test_a_value_of_many_owners_is_an_example(spark):
    value, rare = "9f3kd82ls01mcb57xqpw", "0zk2mv81hsyqp4t6nb3e"
    rows = [(i, f"token = {value}", None, f"s{i}", 0) for i in range(3)] + [(9, f"token = {rare}", None, "s1", 0)] * 2
    found = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert found[0]["spans"] == "assign:0:28,copied:8:28" and found[9]["spans"] == "assign:0:28,live:8:28"


def test_texts_beyond_thousands_of_words(spark):
    rng = random.Random(5)
    parts = [rng.choice(["word", "été", "token = " + "".join(rng.choices("0123456789abcdef", k=40))]) for _ in range(20000)]
    check(spark.createDataFrame([(1, " ".join(parts), None, "s", 0), (2, " ".join(parts[:50]), None, "t", 0)], DOCUMENTS))


def test_plan_has_no_python(spark):
    plan = secrets.scan(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
