import hashlib
import re
import zlib

import numpy as np
import pytest

from tidewright.llm import substring_dedup


def brute(rows, window=20):
    docs = sorted({((1 << 63) - 1 if i is None else i, t or "") for i, t in rows}, key=lambda x: x[0])
    first, out = {}, {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in first:
                gone.update(range(s, s + window))
            else:
                first[key] = (i, s)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i, text] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("bounds", [{}, {"max_anchors": 0, "max_rows": 0}])
@pytest.mark.parametrize("which", ["tiny", "odd"])
def test_against_brute_force(tiny, odd, which, bounds):
    docs = odd if which == "odd" else tiny
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    rows = substring_dedup.deduplicated(docs, **bounds).collect()
    assert len(rows) == docs.count()
    for r in rows:
        key = ((1 << 63) - 1 if r._row.doc_id is None else r._row.doc_id, r._row.text or "")
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == want[key], key[0]


def test_clashing_hashes_do_no_harm(tiny):
    want = brute([(r.doc_id, r.text) for r in tiny.collect()])
    for r in substring_dedup.deduplicated(tiny, bits=14).collect():
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == want[r._row.doc_id, r._row.text], r._row.doc_id


def test_texts_under_one_id_stay_apart(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(None, f"{passage} plumless"), (None, f"{passage} buckeroo"), (None, "a text of its own"), (-3, f"before {passage}")]
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    got = {r._row.text.split()[-1]: r.n_removed for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {"plumless": 25, "buckeroo": 25, "own": 0, "p24": 0}


@pytest.mark.parametrize("bits", [64, 14])
def test_factors_point_at_equal_words(tiny, bits):
    text = {r.doc_id: r.text.split() for r in tiny.collect()}
    seen = 0
    removed = {r._row.doc_id: r.n_removed for r in substring_dedup.deduplicated(tiny).collect()}
    for r in substring_dedup.duplicate_factors(tiny, bits=bits)[0].collect():
        held = set()
        for f in r.factors:
            assert text[r._id][f.start : f.start + f.length] == text[f.source][f.source_start : f.source_start + f.length]
            assert (f.source, f.source_start) < (r._id, f.start) and f.length >= 20
            held.update(range(f.start, f.start + f.length))
            seen += 1
        assert len(held) == removed[r._id]  # what factors hold is what goes
    assert seen


def blocks_of(sources):
    size = substring_dedup.BLOCK
    return {(i, 0, k // size): words[k : k + size] for i, words in sources.items() for k in range(0, len(words), size)}


def test_greedy_parse():
    a, b = [b"a%d" % k for k in range(200)], [b"b%d" % k for k in range(30)]
    words = a[50:150] + [b"x"] + a[10:40] + b[5:28]
    runs = [(0, 40, 1, 0, 50), (101, 30, 1, 0, 10), (131, 23, 2, 0, 5)]
    found, doubts = substring_dedup.parsed(words, runs, blocks_of({1: a, 2: b}), 20)
    assert found == [(0, 100, 1, 0, 50), (101, 30, 1, 0, 10), (131, 23, 2, 0, 5)] and not doubts  # the first grows past its run
    assert substring_dedup.parsed(words, runs, {}, 20) == ([], [p for s, n, *_ in runs for p in range(s, s + n - 19)])  # nothing without blocks
    wrong = blocks_of({1: a, 2: b[:10] + [b"clash"] + b[11:]})
    found, doubts = substring_dedup.parsed(words, runs, wrong, 20)
    assert found[:2] == [(0, 100, 1, 0, 50), (101, 30, 1, 0, 10)] and len(found) == 2 and doubts == [131, 132, 133, 134]


def test_windows_across_a_boundary():
    a, b = [b"a%d" % k for k in range(30)], [b"b%d" % k for k in range(10)]
    own = a + b
    found, _ = substring_dedup.parsed(own, [(0, 30, 1, 0, 0), (15, 25, 3, 0, 0)], blocks_of({1: a, 3: own[15:]}), 20)
    assert found == [(0, 30, 1, 0, 0), (15, 25, 3, 0, 0)] and substring_dedup.spans(found) == [40]


def test_candidates():
    found = [(0, 31, 2, 0, 10), (0, 0, 1, 0, 5), (0, 1, 1, 0, 6), (0, 1, 1, 0, 6), (0, 2, 2, 0, 0), (0, 30, 2, 0, 9), (1, 32, 2, 0, 11), (1, 33, 2, 1, 12)]
    of, runs = substring_dedup.candidates(*np.array(found).T, 20)
    want = [(0, 0, 21, 1, 0, 5), (0, 2, 20, 2, 0, 0), (0, 30, 21, 2, 0, 9), (1, 32, 20, 2, 0, 11), (1, 33, 20, 2, 1, 12)]
    assert list(zip(of, *runs, strict=True)) == want
    assert not len(substring_dedup.candidates(*np.zeros((5, 0), "i8"), 20)[0])


def test_digests_and_stage(tiny, none):
    assert substring_dedup.digests(none).count() == 0
    assert substring_dedup.cleaned_documents(tiny).columns == tiny.columns
    row = substring_dedup.digests(tiny).filter("n_removed = n_words and n_words > 0").first()
    assert row is None or row.kept_sha256 == hashlib.sha256(b"").hexdigest()
