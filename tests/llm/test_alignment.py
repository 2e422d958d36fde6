import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest

from tidewright.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def brute(texts, libraries):
    """By whole texts: cut at the common ends, then list every occurrence pair."""
    (a_lib, b_lib), back, found = libraries, letters(), []
    for t in texts:
        raw = f" {t or ''}".encode()
        a, b = (a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        a_bytes = [bytes(back[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        if not t or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            found.append((0, 0, [], []))
            continue
        a_ends, b_ends = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
        cuts = set(a_ends) & set(b_ends)
        groups = list(zip(parted(a, a_ends, cuts), parted(b, b_ends, cuts), strict=True))
        found.append((len(a), len(b), groups, [(i, j) for x, y in groups for i in x for j in y]))
    holding = Counter(p for *_, links in found for p in set(links))
    most = defaultdict(int)
    for (i, _), n in holding.items():
        most[i] = max(most[i], n)
    out = []
    for n_a, n_b, groups, links in found:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(holding[p] == most[p[0]] for p in links), sum(holding[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if n_a else ""))
    return out


def parted(ids, ends, cuts):
    """ids, cut where their ends are in cuts."""
    out = [[]]
    for i, e in zip(ids, ends, strict=True):
        out[-1].append(i)
        if e in cuts:
            out.append([])
    return out[:-1]


def check(docs, libraries, **more):
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id or -1, *x) for r, x in zip(rows, brute([r.text for r in rows], libraries), strict=True))
    got = alignment.alignment(docs, A, B, **more)
    assert sorted((r.doc_id or -1, *(r[c] for c in COLUMNS)) for r in got.collect()) == want


@pytest.mark.parametrize("max_pairs", [0, alignment.MAX_PAIRS])
def test_odd(odd, none, libraries, max_pairs):
    check(odd, libraries, max_pairs=max_pairs)
    assert alignment.alignment(none, A, B, max_pairs=max_pairs).count() == 0


@pytest.mark.parametrize("max_pairs", [0, alignment.MAX_PAIRS])
def test_documents(tiny, libraries, max_pairs):
    check(tiny, libraries, max_pairs=max_pairs)


def test_random_strings(spark, libraries):
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "\t", "a", "The", "naïve", "日本", "é", "é", "▁", "<|endoftext|>", "<s>", "<0x41>", " ", "　", "ﬁ", "😀", "123", "...", "'s", "\u0000", "word", "ünter", "ß", "\x1c"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(1500)] + ["x" * 9000, "日" * 700, "é1" * 500]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), libraries)


def test_groups_hold_every_overlap():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 40)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) for _ in range(2))
        cuts = sorted({*a} & {*b})
        want = [(sum(x <= lo for x in a), sum(x <= hi for x in a), sum(x <= lo for x in b), sum(x <= hi for x in b)) for lo, hi in zip([0, *cuts], cuts)]
        assert alignment.groups(a, b) == want
        assert len(alignment.overlaps(a, b)) == len(a)
        for k, (first, last) in enumerate(alignment.overlaps(a, b)):
            s, e = ([0, *a][k], a[k])
            assert [j for j in range(len(b)) if max(s, [0, *b][j]) < min(e, b[j])] == list(range(first, last + 1))


def test_real_outputs(spark, libraries):
    docs = spark.createDataFrame([(1, "naïve words"), (2, "naïve")], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.alignment(docs, A, B, texts=True).collect()}
    assert rows[1].groups.startswith(rows[2].groups) and rows[1].n_groups == rows[1].groups.count(";") + 1
    pairs = alignment.pair_counts(alignment.aligned(docs, A, B)).collect()
    assert {(r.a_id << 32 | r.b_id) == r.key for r in pairs} == {True} and max(r.n_docs for r in pairs) == 2
