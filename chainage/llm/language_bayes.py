"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every other character counts as a blank. The n-grams of one to three characters that hold no two
blanks side by side are hashed into buckets; texts are bounded by blanks. Buckets are counted per language in tasks and
added up by Spark. The matrix of log probabilities (buckets by languages, at most ``most_languages``, so its size is bounded
and checked) goes to every task as a broadcast, and a block of texts is scored as a sparse product: rows of the matrix are
taken for the n-grams that occur and added up per text.

Texts of any length are read in blocks of about a million characters, with the n-grams over a block's border counted once.
Null texts and texts without a letter are ``und`` with score 0, as are all texts if nothing could be learnt. Rows without a
language, and rows of the held-out fold, are not learnt from; a null id counts as the empty text and so is held out. Repeated
rows count as often as they occur. Equal scores go to the language that sorts first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import crc_of, mix, stored, text_bytes

BLANK = 32
ORDER = 3
BLOCK = 1 << 20
UNKNOWN = "und"
#: Languages counted at a time in a task; beyond it counts are passed on and started anew.
HELD = 64
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_folded: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """For every code point its lower-case letter, or a blank; made once per worker."""
    if not _folded:
        letters = (ord(c.lower()[0]) if c.isalpha() else BLANK for c in map(chr, range(0x110000)))
        _folded.append(np.fromiter(letters, np.uint32, 0x110000))
    return _folded[0]


def pieces(texts: list[bytes], size: int):
    """Lists of (text number, codes, n-gram starts among them), each of about ``size`` characters in all."""
    table, held, total = fold_table(), [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        # Bytes that are not UTF-8 count as blanks.
        raw = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        codes = np.concatenate([[np.uint32(BLANK)], table[raw], [np.uint32(BLANK)]])
        for a in range(0, len(codes), size):
            part = codes[a : a + size + ORDER - 1]
            held.append((i, part, min(size, len(codes) - a)))
            total += len(part)
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


@dataclass(frozen=True)
class Block:
    """Buckets of the n-grams of some pieces, an array per order; ``buckets`` itself stands for no n-gram."""

    text: np.ndarray
    first: np.ndarray
    letters: np.ndarray
    grams: list[np.ndarray]


def hashed(parts: list, bits: int) -> Block:
    none = 1 << bits
    # A zero ends a piece, so that no n-gram leads from one text to another.
    codes = np.concatenate([x for _, c, _ in parts for x in (c, np.zeros(1, np.uint32))])
    sizes = np.array([len(c) + 1 for _, c, _ in parts])
    first = np.concatenate([[0], sizes.cumsum()[:-1]])
    starts = np.ones(len(codes), bool)
    for at, (_, c, n) in zip(first, parts, strict=True):
        starts[at + n : at + len(c)] = False
    blank, end = codes == BLANK, codes == 0
    fits = starts & ~blank & ~end
    joined = ~(end[:-1] | end[1:] | (blank[:-1] & blank[1:]))
    grams, h = [], codes.astype(np.uint64)
    for k in range(1, ORDER + 1):
        if k == 2:
            fits = starts & np.append(joined, False)
        elif k > 2:
            fits = fits & np.concatenate([joined[k - 2 :], np.zeros(k - 1, bool)])
        if k > 1:
            h = h[:-1] * _PRIME + codes[k - 1 :]
        bucket = np.full(len(codes), none, np.int64)
        bucket[: len(h)] = mix(h + np.uint64(k)) >> np.uint64(64 - bits)
        bucket[~fits] = none
        grams.append(bucket)
    letters = np.add.reduceat(~(blank | end), first, dtype=np.int64)
    return Block(np.array([i for i, _, _ in parts]), first, letters, grams)


def _counts(docs: DataFrame, bits: int) -> DataFrame:
    """``lang, bucket, times``; bucket -1 counts the texts."""
    none = 1 << bits

    def flushed(held):
        for lang, (texts, times) in held.items():
            at = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(at) + 1)),
                    pa.array(np.append(at, -1).astype(np.int32)),
                    pa.array(np.append(times[at], texts)),
                ],
                ["lang", "bucket", "times"],
            )

    def counted(batches):
        held: dict[str, list] = {}
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                if lang not in held and len(held) >= HELD:
                    yield from flushed(held)
                    held = {}
                row = held.setdefault(lang, [0, np.zeros(none, np.int64)])
                row[0] += len(texts)
                for parts in pieces(texts, BLOCK):
                    for bucket in hashed(parts, bits).grams:
                        row[1] += np.bincount(bucket, minlength=none + 1)[:none]
        yield from flushed(held)

    return (
        docs.select("lang", "text")
        .mapInArrow(counted, "lang string, bucket int, times bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("times").alias("times"))
    )


def learn(docs: DataFrame, bits: int, alpha: float, most_languages: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their log priors, and the log probabilities by bucket (and zeros for no n-gram)."""
    counts = stored(_counts(docs, bits), "languages")
    texts = counts.where("bucket = -1").orderBy("lang").limit(most_languages + 1).collect()
    if len(texts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    langs = [r["lang"] for r in texts]
    times = np.zeros(((1 << bits) + 1, len(langs)))
    # At most buckets times languages rows, whatever the corpus.
    found = counts.where("bucket >= 0").toArrow()
    place = {lang: i for i, lang in enumerate(langs)}
    column = [place[lang] for lang in found["lang"].to_pylist()]
    times[found["bucket"].to_numpy(), column] = found["times"].to_numpy()
    logs = np.log((times + alpha) / (times.sum(0) + alpha * (1 << bits)))
    logs[-1] = 0
    given = np.array([r["times"] for r in texts], float)
    return langs, np.log(given / given.sum()) if langs else given, logs


def joint(texts: list[bytes], prior: np.ndarray, logs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of every text in every language, and its number of letters."""
    score, letters = np.tile(prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
    # The rows taken for a block stay within a few ten megabytes, however many languages there are.
    for parts in pieces(texts, max(1 << 12, min(BLOCK, (1 << 22) // max(1, len(prior))))):
        block = hashed(parts, bits)
        taken = logs[block.grams[0]]
        for bucket in block.grams[1:]:
            taken += logs[bucket]
        np.add.at(score, block.text, np.add.reduceat(taken, block.first, axis=0))
        np.add.at(letters, block.text, block.letters)
    return score, letters


def identify(
    docs: DataFrame, folds: int = 5, fold: int = 0, bits: int = 16, alpha: float = 0.1, most_languages: int = 256
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; ``score`` is the probability of the language found."""
    held_out = crc_of("doc_id") % folds == fold
    usable = docs.where(~held_out).select(F.col("lang").cast("string").alias("lang"), text_bytes().alias("text"))
    langs, prior, logs = learn(usable.where("lang is not null"), bits, alpha, most_languages)
    model = docs.sparkSession.sparkContext.broadcast((prior, logs))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), text_bytes().alias("text")
    )
    names = pa.array([*langs, UNKNOWN])

    def scored(batches):
        prior, logs = model.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            best, share = np.full(len(texts), len(langs)), np.zeros(len(texts))
            if langs and texts:
                score, letters = joint(texts, prior, logs, bits)
                top = score.max(1)
                best = np.where(letters > 0, score.argmax(1), len(langs))
                share = np.where(letters > 0, 1 / np.exp(score - top[:, None]).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), names.take(pa.array(best)), pa.array(share)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(scored, "doc_id bigint, held_out boolean, lang_pred string, score double")
