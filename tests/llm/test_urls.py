import math
import random
import re

from wardline.llm import urls

PAGES = "page_id long, url string, html string, host string"
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for text, verdict in RULES:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(text), text, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def sample(spark):
    rng = random.Random(4)
    odd = [None, "", "no scheme", "http://", "http://net", "http://NET/", "http://a.net/x", "http://xnet/", "http://EXAMPLE.net/en/1?x", "http://b.example.net/en"]
    odd += ["http://example.net?en/", "ftp://example.com/de/#f", "http://é.org/fr/ü", "http://a.org/fr/x/../net/", "a://b://c/d", "http://net/\nnew", "http://x.net:80/en/"]
    made = [f"http{'s' * (i % 2)}://{rng.choice(['m.', 'www.', ''])}site{i}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'fr', 'de'])}/{i}" for i in range(400)]
    return spark.createDataFrame([(None if i == 7 else i, u, "h", "clash") for i, u in enumerate(odd + made + odd)], PAGES)


def test_rules(spark):
    frame = sample(spark)
    got = urls.judge(frame, RULES).collect()
    want = sorted((brute(r["url"])[:3] for r in frame.collect()), key=repr)
    assert sorted(((r["host"], r["path"], r["rule"]) for r in got), key=repr) == want
    verdict = dict(RULES)
    assert all(r["verdict"] == verdict[r["rule"]] and r["by"] == "rule" for r in got if r["rule"])
    assert all(r["verdict"] in ("allow", "block") and r["by"] == "model" for r in got if not r["rule"])


def test_model_is_a_distribution_and_separates():
    rng = random.Random(1)
    good = [f"http://shop{rng.randrange(999)}.example/news/{rng.randrange(99)}" for _ in range(300)]
    bad = [f"http://casino{rng.randrange(999)}.example/win?bonus={rng.randrange(99)}" for _ in range(300)]
    alphabet = sorted(set("".join(good + bad))) + [urls.END]
    model = urls.CharModel(good, 4, len(alphabet) + 1)
    for prefix in ("http", "", "http://shop1", "zzz"):
        text = urls.START + prefix
        assert abs(sum(step(model, text, c) for c in [*alphabet, "\x04"]) - 1) < 1e-6, prefix
    both = urls.UrlModel(urls.CharModel(good[:200], 4, 60), urls.CharModel(bad[:200], 4, 60))
    both.threshold = urls.calibrate([(both.ratio(u), True) for u in good[200:250]] + [(both.ratio(u), False) for u in bad[200:250]])
    assert all(both.ratio(u) >= both.threshold for u in good[250:])
    assert all(both.ratio(u) < both.threshold for u in bad[250:])


def step(model, text, c):
    weight = 1.0
    for k in range(min(model.order, len(text)), -1, -1):
        context = text[len(text) - k :]
        if context + c in model.seen:
            return weight * model.seen[context + c]
        weight *= model.shorter.get(context, 1.0)
    return weight * model.floor


def test_likelihood_is_the_product_of_its_steps():
    model = urls.CharModel(["http://a.b/c", "http://a.b/d"], 3, 20)
    text = urls.START + "http://q.b/" + urls.END
    want = sum(math.log(step(model, text[:i], text[i])) for i in range(1, len(text)))
    assert abs(model.log_likelihood("http://q.b/") - want) < 1e-9


def test_calibration():
    assert urls.calibrate([]) == 0.0
    assert urls.calibrate([(1.0, True)]) == 0.0
    assert urls.calibrate([(-1.0, False), (1.0, True)]) == 0.0
    assert 2 < urls.calibrate([(1.0, False), (2.0, False), (3.0, True), (4.0, True)]) < 3


def test_without_examples(spark):
    frame = spark.createDataFrame([(1, "http://a.com/", None, None), (2, None, None, None)], PAGES)
    assert {r["verdict"] for r in urls.judge(frame, RULES).collect()} == {"allow"}
    assert urls.judge(spark.createDataFrame([], PAGES), RULES).collect() == []


def test_models_learn_from_every_ruled_url(spark):
    """More URLs in a class than any fixed sample; each URL's ratio is that of models in memory on all of them."""
    rng = random.Random(9)
    made = {f"http://{'www.' * (i % 2)}{rng.choice('abcdef')}{i}.{'net' if i % 2 else 'org/fr'}/{rng.randrange(10**5):x}" for i in range(13000)}
    made = sorted(made) + ["http://é.com/ü", "http://a.com/b", "x"]
    frame = spark.createDataFrame([(i, u, None, None) for i, u in enumerate([*made, None, "", made[0]])], PAGES)
    hashed = {r["url"]: r["h"] for r in frame.selectExpr("url", "xxhash64(url) as h").collect()}
    verdicts = {u: brute(u)[3] for u in made}
    ordered = {v: sorted((u for u in made if verdicts[u] == v), key=hashed.get) for v in ("allow", "block")}
    train = {v: [u for k, u in enumerate(us, 1) if k % 5] for v, us in ordered.items()}
    assert all(len(t) > 5000 for t in train.values())
    alphabet = len(set("".join(u for u in made if verdicts[u]))) + 2
    model = urls.UrlModel(*(urls.CharModel(train[v], urls.ORDER, alphabet) for v in ("allow", "block")))
    want = {u: model.ratio(u) for u in made} | {None: 0.0, "": 0.0}
    threshold = urls.calibrate([(want[u], verdicts[u] == "allow") for us in ordered.values() for u in us[4::5]])
    got = {r["page_id"]: r for r in urls.judge(frame, RULES).collect()}
    assert len(got) == len(made) + 3
    for i, u in enumerate([*made, None, "", made[0]]):
        assert abs(got[i]["ratio"] - want[u]) < 1e-9, u
        assert got[i]["verdict"] == (verdicts.get(u) or ("allow" if not u or want[u] >= threshold else "block"))


def test_threshold_of_a_table_is_that_of_a_list(spark):
    rng = random.Random(10)
    assert urls.calibrate_table(spark.createDataFrame([(1.0, True)], "ratio double, accepted boolean")) == 0.0
    for n in (2, 5, 60, 400):
        scores = [(rng.randrange(20) / 7 + ok, ok) for ok in (True, False, *(rng.random() < 0.3 for _ in range(n)))]
        assert abs(urls.calibrate_table(spark.createDataFrame(scores, "ratio double, accepted boolean")) - urls.calibrate(scores)) < 1e-12
