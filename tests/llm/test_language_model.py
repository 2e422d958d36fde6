import glob
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewright.llm import common, language_model


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


@pytest.mark.parametrize("options", [{}, {"frequent": 50}, {"max_filter": 0}])
@pytest.mark.parametrize("which", ["tiny", "odd"])
def test_base_scores(tiny, odd, which, options):
    docs = odd if which == "odd" else tiny
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        own = tokens(r.text)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        want.append((r.doc_id or -1, held(r.doc_id), len(own), sum(counts[t] > 0 for t in own), total, base))
    got = [(r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in language_model.scored(docs, **options).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)


def test_broadcast_and_shuffle_agree(tiny, odd):
    for docs in (tiny, odd):
        one = sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in language_model.scored(docs).collect())
        assert one == sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in language_model.scored(docs, max_filter=0).collect())


def test_held_out_text_is_likelier_than_under_the_base(spark):
    rows = [r for r in language_model.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.score < 0 for r in rows)
    assert sum(r.score for r in rows) / sum(r.n_tokens for r in rows) > -3.5


def test_filter_never_loses_an_entry():
    rng = np.random.default_rng(1)
    keys, counts = np.unique(rng.integers(1, 1 << 63, 20_000).astype("u8")), None
    counts = rng.integers(1, 2000, len(keys))
    of = language_model.block_of(keys, 7)
    made = language_model.Filter(7, [(b, language_model.built(keys[of == b], counts[of == b])) for b in range(7)])
    assert (made.levels(keys) >= language_model.level(counts)).all()
    absent = made.levels(rng.integers(1, 1 << 63, 20_000).astype("u8"))
    assert (absent > 0).mean() < 0.04 and (made.levels(keys) == language_model.level(counts)).mean() > 0.95


def test_empty(none):
    assert language_model.scored(none).count() == 0


def test_score_against_brute_force(tiny):
    rows = tiny.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [tokens(r.text) for r in rows if not held(r.doc_id)]
    words, both = Counter(t for own in train for t in own), Counter(x for own in train for x in zip([None, *own], own))  # noqa: B905
    three = Counter(x for own in train for x in zip([None, *own], own, own[1:]))  # noqa: B905
    denominator = sum(words.values()) + len(words) + 1
    lower = lambda c: 1 << c.bit_length() - 1 if c else 0
    upper = lambda c: (1 << c.bit_length()) - 1

    def score(own):
        total, u, v = 0.0, None, None
        for k, w in enumerate(own):
            n = min(lower(both[v, w]), words[w], words[v])
            p = (n + 300 * (words[w] + 1) / denominator) / (words[v] + 300)
            if k:
                wide = min(upper(both[u, v]), words[u], words[v])
                p = (min(lower(three[u, v, w]), n, wide) + 10 * p) / (wide + 10)
            total, u, v = total + math.log10(p), v, w
        return total

    got = {r.doc_id: r for r in language_model.scored(tiny).collect()}
    over = np.array([abs(got[r.doc_id].score - score(own)) / len(own) for r in rows if len(own := tokens(r.text)) > 50])
    assert over.mean() < 0.02 and over.max() < 0.15  # what is left are false positives of the filter


def test_portions_survive_their_packing():
    rng = np.random.default_rng(3)
    for vocabulary, lengths in ((50, [3, 1, 900]), (90_000, [200_000, 1])):
        words, ids, held = rng.integers(1, vocabulary, sum(lengths)).astype("u8") << np.uint64(30), pa.array([None, 7, 8][: len(lengths)], pa.int64()), pa.array([False, True, True][: len(lengths)])
        packed = language_model.closed(ids, held, words, np.array(lengths, "i8"))
        own = language_model.opened(pa.scalar(packed, pa.binary()))
        assert own[0].equals(ids) and own[1].equals(held) and (own[2] == words).all() and own[3].tolist() == lengths and len(packed) < words.nbytes


def test_shuffled_tables_have_no_large_rows_or_row_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "removed", lambda spark, paths: None)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 0")  # some 12 MB of text in one task
    with common.scratch() as tables:
        language_model.scored(docs, max_filter=0)
    seen = 0
    for path in tables:
        for file in glob.glob(f"{path.removeprefix('file:')}/*.parquet"):
            meta = pq.ParquetFile(file).metadata
            seen += meta.num_rows
            groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
            assert max((g.total_byte_size for g in groups), default=0) < 12 << 20, path  # executors hold a few of them
            if "lm-portions" in path:
                assert all(g.total_byte_size < (3 << 20) * g.num_rows for g in groups)
    assert seen > 0 and any("lm-portions" in path for path in tables)
