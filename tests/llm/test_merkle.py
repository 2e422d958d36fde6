import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidewright.llm import merkle
from tidewright.llm.common import id_remainder

NAMES = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def up(items, arity):
    """The top over items (digest, members), whose members get their siblings."""
    while len(items) > 1:
        above = []
        for k in range(0, len(items), arity):
            run = items[k : k + arity]
            for j, (_, members) in enumerate(run):
                for m in members:
                    m["path"].append(([d for d, _ in run[:j]], [d for d, _ in run[j + 1 :]]))
            above.append((h(d for d, _ in run), [m for _, members in run for m in members]))
        items = above
    return items[0]


def brute(rows, arity):
    trees = {}
    for r in rows:
        values = [r.doc_id, r.source, r.lang, r.n_chars, r.text]
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
        m = {"id": r.doc_id, "leaf": h(map(field, values)), "shown": h(map(field, [*values[:3], r.n_chars + tampered if tampered else r.n_chars, r.text])), "path": []}
        trees.setdefault((r.lang is not None, (r.lang or "").encode()), []).append(m)
    tops = []
    for _, members in sorted(trees.items()):
        members.sort(key=lambda m: (m["id"] is not None, m["id"] or 0, m["leaf"]))
        top = up([(m["leaf"], [m]) for m in members], arity)
        for m in members:
            m["subroot"] = top[0]
        tops.append(top)
    root, members = up(tops, arity)
    out = []
    for m in members:
        node = m["shown"]
        for before, behind in m["path"]:
            node = h([*before, node, *behind])
        proof = h(d for before, behind in m["path"] for d in [*before, *behind])
        out.append((-1 if m["id"] is None else m["id"], m["leaf"], m["subroot"], root, proof, node, node == root))
    return sorted(out)


def check(docs, arity=2):
    found = merkle.manifest(docs, F.coalesce(id_remainder(7) == 0, F.lit(False)), arity).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in NAMES)) for r in found) == brute(docs.collect(), arity)


@pytest.mark.parametrize(("arity", "fan", "part_rows"), [(2, 16, 50_000), (2, 2, 7), (3, 4, 10)])
def test_documents(tiny, arity, fan, part_rows, monkeypatch):
    monkeypatch.setattr(merkle, "FAN", fan)
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    check(tiny, arity)


def test_odd(odd, none):
    check(odd)
    assert merkle.manifest(none).count() == 0


@pytest.mark.parametrize("max_rows", [0, 200_000])
def test_many_trees_and_one_hot_one(spark, max_rows, monkeypatch):
    monkeypatch.setattr(merkle, "MAX_ROWS", max_rows)
    monkeypatch.setattr(merkle, "PART_ROWS", 20)
    rows = [(k, "s", None if k % 3 == 0 else "é" if k % 3 == 1 else f"lang {k}", None if k % 5 == 0 else k, f"text {k}") for k in range(300)]
    rows += [(7, "s", "é", 7, "the same row")] * 60 + [(1 << 40, "", "z", (1 << 63) - 1, "")]
    check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))


def test_one_row(spark):
    check(spark.createDataFrame([(3, "s", "en", 1, "t")], "doc_id long, source string, lang string, n_chars long, text string"))


def test_merging_is_associative_and_commutative():
    digests = [h([str(k)]) for k in range(23)]
    whole = merkle.Forest(23, 2)
    whole.levels[0].update(enumerate(digests))
    whole.close()

    def fragment(indexes):
        f = merkle.Forest(23, 2)
        f.levels[0].update({k: digests[k] for k in indexes})
        return f.close()

    def met(a, b):
        f = merkle.Forest(23, 2)
        for x in (a, b):
            for level, nodes in enumerate(x.levels):
                f.levels[level].update({i: d for i, d in nodes.items() if x.state(level, i) != merkle.KNOWN})
        return f.close()

    a, b, c = fragment(range(0, 9)), fragment(range(9, 10)), fragment(range(10, 23))
    tops = {m.levels[-1][0] for m in (met(met(a, b), c), met(a, met(b, c)), met(met(c, a), b))}
    assert tops == {whole.levels[-1][0]}
