"""Language identification against a plain naive Bayes, and held-out accuracy."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chainage.llm import language_bayes as lb
from chainage.llm.common import mix
from test_operators import SCHEMA

BITS = 12
TEXTS = [
    ("en", "The cat and the dog are on the mat with 3 others."),
    ("en", "this and that, of the other"),
    ("de", "Der Hund und die Katze sind auf der Straße"),
    ("de", "Über die Brücke, ÄÖÜ und ß"),
    ("fr", "le chat et le chien été à la plage"),
    ("zh", "中文 字符 和 汉字"),
    ("en", None),
    ("en", ""),
    ("en", "12 345 --- \t\n"),
    (None, "and the of on the mat"),
    (None, "und die der"),
    ("de", "İx und ǅ " * 50),
    ("en", "the " * 3000),
    ("en", "this and that, of the other"),
]


def grams(text: str | None) -> list[int]:
    """Buckets of the n-grams, straight from the definition."""
    letters = [c.lower()[0] if c.isalpha() else " " for c in text or ""]
    codes = [" ", *letters, " "] if text else []
    out = []
    for k in range(1, lb.ORDER + 1):
        for p in range(len(codes) - k + 1):
            gram = codes[p : p + k]
            if (k == 1 and gram == [" "]) or any(a == b == " " for a, b in zip(gram, gram[1:], strict=False)):
                continue
            h = 0
            for c in gram:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            out.append(int(mix(np.array([(h + k) % 2**64], np.uint64))[0]) >> (64 - BITS))
    return out


def brute(rows: list[tuple], alpha: float = 0.1) -> list[tuple]:
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    times, texts = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if lang is not None and not held(i):
            times[lang].update(grams(text))
            texts[lang] += 1
    out = []
    for i, text, _ in rows:
        best, share = "und", 0.0
        if texts and any(c.isalpha() for c in text or ""):
            joint = {}
            for lang in sorted(texts):
                n = sum(times[lang].values()) + alpha * 2**BITS
                joint[lang] = math.log(texts[lang] / sum(texts.values())) + sum(
                    math.log((times[lang][g] + alpha) / n) for g in grams(text)
                )
            best = max(joint, key=joint.get)
            share = 1 / sum(math.exp(v - joint[best]) for v in joint.values())
        out.append((str(i), held(i), best, round(share, 8)))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "h", 1) for i, t, lang in rows], SCHEMA)


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lb, "BLOCK", block)
    rows = [(i, text, lang) for i, (lang, text) in enumerate(TEXTS * 3)]
    rows += [rows[4], rows[4], (None, "the mat", "en"), (None, None, None)]
    got = lb.identify(frame(spark, rows).repartition(4), bits=BITS)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 8)) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("size", [5, 7, 64])
def test_long_texts_are_cut_without_loss(size):
    """Whatever the blocks, every n-gram is counted once."""
    texts = [t.encode() for _, t in TEXTS if t is not None]
    want = Counter(g for _, t in TEXTS for g in grams(t))
    got = Counter()
    for parts in lb.pieces(texts, size):
        for bucket in lb.hashed(parts, BITS).grams:
            got.update(bucket[bucket < 2**BITS].tolist())
    assert got == want


def test_nothing_learnt_and_empty(spark):
    rows = [(1, "the cat", None), (2, None, None)]
    assert {(r.lang_pred, r.score) for r in lb.identify(frame(spark, rows)).collect()} == {("und", 0.0)}
    assert lb.identify(frame(spark, [])).count() == 0


def test_more_languages_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(lb, "HELD", 2)
    rows = [(i, f"{chr(97 + i % 6) * 3} word", f"l{i % 6}") for i in range(60)]
    got = lb.identify(frame(spark, rows), bits=BITS).collect()
    assert [(str(r.doc_id), r.lang_pred) for r in got] == [(i, p) for i, p in ((str(r[0]), f"l{r[0] % 6}") for r in rows)]
    with pytest.raises(ValueError, match="languages"):
        lb.identify(frame(spark, rows), bits=BITS, most_languages=5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lb.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 150
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
