import weakref
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewright.llm import common, packing, token_counts, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def check_counts(docs, encode):
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(encode(r.text))) for r in docs.collect())
    rows = token_counts.token_counts(docs, PATH).collect()
    got = [(r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows]
    assert sorted(got) == want and all(r.over_limit == (r.n_tokens > 512) for r in rows)


def test_counts(spark, sf, odd, none, encode):
    check_counts(spark.read.parquet(f"{sf}/documents.parquet"), encode)
    check_counts(odd, encode)
    assert token_counts.token_counts(none, PATH).count() == 0


def check_packing(docs, encode, room):
    want = defaultdict(list)
    for r in docs.collect():
        ids = [*encode(r.text), 2]
        start, stop, k = 0, len(ids) % room or min(room, len(ids)), 0
        while start < len(ids):
            part = np.array(ids[start:stop], "<u4")
            want[r.doc_id or -1].append((k, start, stop - start, zlib.crc32(part.tobytes())))
            start, stop, k = stop, stop + room, k + 1
    rows = packing.pack(docs, PATH, room).collect()
    got, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id or -1].append((r.piece, r.start, r.length, r.ids_crc32))
        fill[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    least = -(-sum(r.length for r in rows) // room)
    return len(fill), least


def test_packing(spark, sf, odd, none, encode):
    used, least = check_packing(spark.read.parquet(f"{sf}/documents.parquet"), encode, 1024)
    assert used <= least + 2
    check_packing(odd, encode, 1024)
    check_packing(odd, encode, 7)
    assert packing.pack(none, PATH).count() == 0


def least_bins(sizes, room):
    """By trying all."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for b in sorted(set(bins)):
            if b + sizes[k] <= room:
                i = bins.index(b)
                go(k + 1, [*bins[:i], b + sizes[k], *bins[i + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best


def test_dominance_keeps_an_optimum():
    rng = np.random.default_rng(3)
    for _ in range(300):
        room = int(rng.integers(8, 30))
        sizes = sorted(map(int, rng.integers(1, room + 1, rng.integers(1, 10))), reverse=True)
        count = np.bincount(sizes, minlength=room + 1).tolist()
        fixed = packing.dominance(count, room)
        rest = [s for s in range(room, 0, -1) for _ in range(count[s])]
        assert sorted([*rest, *(s for f, n in fixed for s in f * n)], reverse=True) == sizes
        assert all(sum(f) <= room for f, _ in fixed)
        assert sum(n for _, n in fixed) + least_bins(rest, room) == least_bins(sizes, room)


def test_plan_places_each_item_once():
    rng = np.random.default_rng(4)
    counts = {int(s): int(rng.integers(1, 60)) for s in rng.integers(1, 65, 40)}
    runs, fill = packing.plan(counts, 64), defaultdict(list)
    for s, run in runs.items():
        at = 0
        for first, stop, base, times, offset in run:
            assert first == at
            at = stop
            for rank in range(first, stop):
                fill[base + (rank - first) // times].append((offset + (rank - first) % times * s, s))
        assert at == counts[s]
    for places in fill.values():
        at = 0
        for offset, s in sorted(places):
            assert offset == at
            at += s
        assert at <= 64
    gaps = []  # best fit decreasing, one by one
    for s in sorted(counts, reverse=True):
        for _ in range(counts[s]):
            gap = min((g for g in gaps if g >= s), default=64)
            if gap in gaps:
                gaps.remove(gap)
            gaps.append(gap - s)
    assert len(fill) <= len(gaps)


def test_texts_of_lines_and_marks(encode):
    """Random strings of spaces, line feeds, marks, letters of several kinds, digits and a special string."""
    bpe = tokens.ByteBpe(PATH)
    parts = ["", " ", "\n", "word", "Wörter", ".", ",", "'s", "7", "слово", "\t", "\u00a0", "e\u0301", "<|endoftext|>"]
    single, texts = bpe.single(), {""}
    rng = np.random.default_rng(0)
    for _ in range(20_000):
        texts.add("".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(1, 9))))
    count = bpe.counter(single)
    for text in texts:
        ids = encode(text)
        assert bpe.encode(text) == np.array(ids, "<u4").tobytes() and count(text) == len(ids)


def test_a_rare_word_is_merged_once_for_all_its_marks(encode, monkeypatch):
    bpe, merged = tokens.ByteBpe(PATH), []
    assert bpe.whole_ids
    merge = bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda word: merged.append(word) or merge(word))
    text = "x ouéaieuxlepa, ouéaieuxlepa. oftionntenerst; ouéaieuxlepa oftionntenerst! ouéaieuxlepa: оченьредкое, a, a. \u00aa, ouéaieuxlepa.. .,"
    assert bpe.encode(text) == np.array(encode(text), "<u4").tobytes()
    assert sum("lepa" in word for word in merged) == 2 and sum("nerst" in word for word in merged) == 1  # with two marks it goes by itself


@pytest.mark.parametrize("entries", [1, 2, 50])
def test_a_full_cache_of_ids(encode, entries, monkeypatch):
    monkeypatch.setattr(tokens, "ID_ENTRIES", entries)
    bpe = tokens.ByteBpe(PATH)
    text = " ".join(f"word{'abcdefg'[k % 7]}{'' if k % 3 else ','} {'Wörtchen' * (k % 11)}{'.' * (k % 2)}x" for k in range(300))
    assert bpe.encode(text) == np.array(encode(text), "<u4").tobytes()


def test_fewer_chunks_are_remembered_on_request(encode):
    bpe = tokens.ByteBpe(PATH, 20)
    text = " ".join(f"rare{k:x}word{k % 3 * '.'}" for k in range(300))
    assert bpe.encode(text) == np.array(encode(text), "<u4").tobytes() and len(bpe._ids) <= 20


def test_what_is_remembered_is_freed():
    kept = weakref.ref(tokens.byte_bpe(PATH))
    assert kept().encode("some words are remembered") and kept() is tokens.byte_bpe(PATH)
    common.forget()
    assert kept() is None
