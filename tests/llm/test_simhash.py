import random

import xxhash

from tests.llm.helpers import DOCUMENTS, awkward, nothing, words
from wardline.llm import simhash


def brute_fingerprint(text, k=4):
    parts = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(parts[i : i + k]) for i in range(max(1, len(parts) - k + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids_and_fps, distance=4):
    root = {fp: fp for _, fp in ids_and_fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(b)] = find(a)
    least = {}
    for i, fp in ids_and_fps:
        if i is not None:
            r = find(fp)
            least[r] = min(i, least.get(r, i))
    return [(i, f"{fp:016x}", least.get(find(fp))) for i, fp in ids_and_fps]


def test_fingerprints_and_components(spark):
    docs = awkward(spark)
    fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted(brute_components(fps), key=repr)


def fingerprint_table(spark):
    """A cloud within six bits of a centre, chains, and values far from each other."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    cloud = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(250)}
    chain, x = set(), rng.getrandbits(64)
    for _ in range(40):
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
        chain.add(x)
    return sorted(cloud | chain | {rng.getrandbits(64) for _ in range(500)})


def test_links_connect_what_brute_force_connects(spark):
    values = fingerprint_table(spark)
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    want = {fp: comp for _, fp, comp in brute_components(list(enumerate(values)))}
    for pair_block in (2, 16, 1000):  # neighbours alone, mixed, pairs alone
        edges = simhash.links(frame, pair_block=pair_block)
        found = {(r["a"], r["b"]) for r in edges.collect()}
        true = {simhash.signed(int(fp, 16)): comp for fp, comp in want.items()}
        assert all(true[a] == true[b] for a, b in found)
        assert len(found) <= 3 * len(values)  # far fewer than the pairs of the cloud
        label = {simhash.signed(v): v for v in values}
        moved = True
        while moved:
            moved = False
            for a, b in found:
                low = min(label[a], label[b])
                moved |= label[a] != low or label[b] != low
                label[a] = label[b] = low
        groups = {}
        for v in values:
            groups.setdefault(label[simhash.signed(v)], set()).add(want[f"{v:016x}"])
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len(set(want.values()))


def test_long_text_and_dropping(spark):
    rng = random.Random(5)
    text = words(rng, 9000, 5000)
    assert simhash.fingerprint(text.encode(), 4) == brute_fingerprint(text)
    docs = awkward(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    components = {r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == components


def test_only_the_judged_row_goes(spark):
    rng = random.Random(11)
    a, b = words(rng, 100, 5000), words(rng, 100, 5000)
    rows = [(1, a), (2, a.upper()), (2, b), (None, a.title()), (None, words(rng, 50, 5000))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(kept, key=repr) == sorted((r for r in rows if r != (2, a.upper())), key=repr)


def test_no_rows(spark):
    assert simhash.near_duplicates(nothing(spark)).collect() == []
