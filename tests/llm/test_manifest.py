"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from chainage.llm import merkle_manifest as mm
from test_operators import SCHEMA

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: dict, more: int = 0) -> str:
    out = []
    for name in FIELDS:
        v = row[name]
        if v is not None and name == "n_chars":
            v += more
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return sha(*out)


def tree(digests: list[str], fanout: int):
    """The root, and for every leaf its siblings to the left and right at each level."""
    paths, members = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, below = [], []
        for a in range(0, len(digests), fanout):
            run = digests[a : a + fanout]
            for j in range(len(run)):
                for i in members[a + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
            above.append(sha(*run))
            below.append(sum(members[a : a + fanout], []))
        digests, members = above, below
    return digests[0], paths


def brute(rows: list[dict], fanout: int = 2) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    trees = []
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own], fanout)))
    if not trees:
        return []
    root, tops = tree([t[1] for t in trees], fanout)
    out = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            forged = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h = leaf(r, int(forged))
            for left, right in path + top:
                h = sha(*left, h, *right)
            proof = sha(*(s for left, right in path + top for s in left + right))
            out.append((str(r["doc_id"]), leaf(r), subroot, root, proof, h, h == root))
    return sorted(out)


def rows_of(sizes: dict) -> list[dict]:
    out, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            n_chars = None if i % 11 == 0 else (2**63 - 1 if i % 13 == 0 else i)
            text = None if i % 17 == 0 else "" if i % 5 == 0 else f"wörd {i} 中:文-" * (i % 4)
            out.append({"doc_id": i * 7919 % 100_003, "source": None if i % 3 == 0 else "s:1", "lang": lang, "n_chars": n_chars, "text": text})
    return out


def frame(spark, rows):
    data = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "h", 1) for r in rows]
    return spark.createDataFrame(data, SCHEMA).withColumnsRenamed({"hash": "grp", "a.b": "idx"})


def answer(docs) -> list[tuple]:
    return sorted((str(r[0]), *r[1:]) for r in docs.collect())


def test_equals_brute_force_on_hard_rows(spark):
    rows = rows_of({"en": 150, None: 3, "": 1, "é": 2, "z": 5, "de": 1})
    # Repeated rows, different rows of one id, and rows without one.
    rows += [rows[5], rows[5], {**rows[6], "text": "other"}, {**rows[7], "doc_id": None}, {k: None for k in FIELDS}]
    assert answer(mm.checked_documents(frame(spark, rows).repartition(4))) == brute(rows)


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {"en": 2}, {None: 64}, {"a": 1, "b": 1}, {"a": 3, "b": 65, "c": 1}])
def test_every_size_of_tree(spark, sizes):
    rows = rows_of(sizes)
    got = mm.checked_documents(frame(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert answer(got) == brute(rows)


@pytest.mark.parametrize("fanout", [3, 4])
def test_wider_runs(spark, fanout):
    rows = rows_of({"en": 40, "fr": 9, "de": 10, None: 1})
    plain = [F.col(n) for n in FIELDS]
    got = mm.manifest(frame(spark, rows), plain, F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id")}, fanout)
    shown = got.select(
        "doc_id", "leaf", "subroot", "root", mm.proof_digest(F.col("path")), mm.folded(F.col("leaf"), F.col("path"))
    ).collect()
    want = brute(rows, fanout)
    assert sorted((str(r[0]), *r[1:5]) for r in shown) == [w[:5] for w in want]
    assert {r[5] for r in shown} == {want[0][3]}


def test_rows_in_other_files_give_the_same_manifest(spark):
    rows = rows_of({"en": 90, "fr": 20})
    one = answer(mm.checked_documents(frame(spark, rows).repartition(1)))
    assert one == answer(mm.checked_documents(frame(spark, rows[::-1]).repartition(7, "doc_id")))


def test_one_id_for_most_rows(spark):
    """Equal rows are dealt to several tasks, so no task must hold them all."""
    rows = rows_of({"en": 30}) + [rows_of({"en": 1})[0]] * 60
    assert answer(mm.checked_documents(frame(spark, rows).repartition(3))) == brute(rows)
