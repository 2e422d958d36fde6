import re

import numpy as np
import pytest
import xxhash

from tidewright.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items):
    """items: (id, fingerprint)."""
    parent = {k: k for k in range(len(items))}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(items)):
        for b in range(a):
            if (items[a][1] ^ items[b][1]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(items):
        least[root(k)] = min(least.get(root(k), i), i)
    return [least[root(k)] for k in range(len(items))]


@pytest.mark.parametrize("which", ["tiny", "odd"])
def test_documents(tiny, odd, which):
    docs = odd if which == "odd" else tiny
    rows = docs.select("doc_id", "text").collect()
    big = (1 << 63) - 1
    items = [(big if r.doc_id is None else r.doc_id, brute_print(r.text)) for r in rows]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(items, brute_components(items), strict=True))
    got = sorted((big if r.doc_id is None else r.doc_id, r.fingerprint, big if r.component_id is None else r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want


@pytest.mark.parametrize("pair_bucket", [0, 8, 10**6])
def test_links_of_dense_groups(spark, pair_bucket):
    rng = np.random.default_rng(5)
    prints = set()
    for centre in rng.integers(0, 1 << 63, 6):
        x = int(centre)
        for _ in range(40):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
            prints.add(x)
    items = list(enumerate(sorted(prints)))
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in items]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long, node long"), pair_bucket=pair_bucket)
    found = {r.node: r.component for r in simhash.components(links).collect()}
    assert [found.get(i, i) for i, _ in items] == brute_components(items)


def test_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(links).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


def test_one_of_each(tiny, none):
    kept = simhash.one_of_each(tiny)
    groups = simhash.near_duplicates(tiny)
    assert kept.columns == tiny.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in groups.collect()})
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("pair_bucket", [0, 8])
def test_edited_copies_are_alike(spark, pair_bucket, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_BUCKET", pair_bucket)
    rng = np.random.default_rng(3)
    texts = []
    for n in rng.integers(100, 600, 60):
        words = [f"w{x}" for x in rng.integers(0, 5000, n)]
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 8):
            for k in rng.integers(0, n, edits):
                words[k] = f"e{rng.integers(1 << 30)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):  # copies lie behind their text
        for b in range(a - a % 5, a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_alike(docs).collect()) == sorted(set(root))


def kept_of(sets, threshold=0.8):
    """The least of each component of sets that are alike."""
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return sorted(set(root))


@pytest.mark.parametrize(("pair_bucket", "block", "block_shingles"), [(0, 512, 1 << 20), (8, 512, 1 << 20), (8, 40, 1 << 20), (8, 512, 20_000), (10**6, 512, 1 << 20)])
def test_dense_groups_lose_no_link(spark, pair_bucket, block, block_shingles, monkeypatch):
    """300 texts off one of 400 words: most pairs are just under the threshold, some over it."""
    for name, value in (("PAIR_BUCKET", pair_bucket), ("BLOCK", block), ("BLOCK_SHINGLES", block_shingles)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(11)
    base, texts = [f"w{x}" for x in rng.integers(0, 9000, 400)], []
    for k in range(300):
        words = list(base)
        for at in np.sort(rng.choice(60, 4 if k % 50 == 0 else 6, replace=False)) * 6 + 10:
            words[at] = f"e{rng.integers(0, 3) if k % 3 else rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    want = kept_of([{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 1 < len(want) < 290
    assert sorted(r.doc_id for r in simhash.one_of_alike(docs).collect()) == want


def test_shared_counts_every_shingle(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 60, n)).astype("i8") for n in rng.integers(1, 50, 20)] + [np.array([999])]
    left, right = np.arange(0, 12), np.arange(8, 21)
    want = [[len(set(rows[i]) & set(rows[j])) for j in right] for i in left]
    got = simhash.shared(rows, left, right)
    assert all(got[a][b] == want[a][b] for a, i in enumerate(left) for b, j in enumerate(right) if i != j or len(rows[i]))


@pytest.mark.parametrize("one_of", [simhash.one_of_each, simhash.one_of_alike])
def test_rows_without_or_with_repeated_ids(spark, one_of):
    long = " ".join(f"word{k}" for k in range(300))
    rows = [(1, long, "a"), (None, long, "b"), (None, "quite another text than that one there", "c"), (None, "a third text that is unlike the others", "d"), (7, "rows that are repeated as a whole", "e"), (7, "rows that are repeated as a whole", "e"), (7, "a text of its own under a repeated id", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.source for r in one_of(docs).collect()) == ["a", "c", "d", "e", "f"]
    groups = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert groups == {(1, 1), (None, 1), (None, None), (7, 7)}


@pytest.mark.parametrize("pair_bucket", [0, 8])
def test_alike_links_come_from_fingerprints(spark, pair_bucket):
    """Texts that share no band: near fingerprints alone bring them together, and their shingles decide."""
    base = [f"w{k}" for k in range(2000)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join([*base[:-1], "y"]), "quite another text than those", " ".join(f"v{k}" for k in range(400))]
    found = [simhash.shingles(t.encode()) for t in texts]
    fps = [simhash.majority(x[0]) for x in found]
    assert all((fps[0] ^ f).bit_count() <= 2 for f in fps[1:3])
    fps[3] = fps[0]  # near, but not alike
    as_long = lambda x: int(np.uint64(x).view("i8"))
    prints = [(as_long(x[1]), as_long(f), [k * 100 + b for b in range(simhash.BANDS)], len(x[0]), k) for k, (x, f) in enumerate(zip(found, fps, strict=True))]
    prints = spark.createDataFrame(prints, "node long, fp long, bands array<long>, size long, _id long")
    links = simhash.alike_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), prints, 5, 0.8, pair_bucket)
    of = {r.node: r.component for r in simhash.components(links).collect()}
    assert set(of) == {as_long(x[1]) for x in found[:3]} and len(set(of.values())) == 1
