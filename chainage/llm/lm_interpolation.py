"""LM scoring by deleted interpolation.

Every order's maximum-likelihood estimate is mixed with the estimate of the order below; the weight depends
on how often the context was seen (a bucket for each power of two) and is learned by expectation-maximisation
on held-out counts: a tenth of the training documents is deleted from the counts for that step and counted
again afterwards. The lowest order is uniform over V + 1 words, so no text has probability zero.

How it runs on Spark:

1. ``encode``: documents are cut into blocks of bounded size and written once as token numbers.
2. Each block asks for the counts of its *distinct* n-grams, so a frequent n-gram is sent once per block and
   not once per occurrence. The questions are shuffled by the n-gram's hash, in packed sorted arrays; the
   reducer adds up the counts and answers every block in the order of its question.
3. Blocks and answers meet again by block number. Blocks of deleted documents give the rows for the EM steps;
   all blocks give the scores.

Counts are exact but for collisions of 64-bit hashes. Nothing of the corpus passes the driver but N, V and the
weights. Nulls and empty texts score as their end token. A null id counts as the empty text where the fold is
drawn. Without any training token all counts are zero and the uniform distribution remains.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import crc_of, lowered_words, mix, stored, text_bytes

START, END = 0, 1
#: A blank is in no word, so these cannot meet a word's key.
START_KEY, END_KEY = xxhash.xxh64_intdigest(b" start", 1), xxhash.xxh64_intdigest(b" end", 1)
BUCKETS = 24
BLOCK = (
    "block bigint, deleted boolean, doc_ids array<bigint>, held array<boolean>, lens array<int>,"
    " tokens binary, vocab binary, n_train bigint"
)
ASKED = "bucket bigint, block bigint, level int, keys binary, main binary, dev binary"
ANSWER = "block bigint, level int, bucket bigint, main binary, dev binary, distinct bigint"
SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
    " base_score double, score double"
)


@dataclass(frozen=True)
class Weights:
    """N and V of the training tokens; ``mix[k - 1][bucket]`` is the weight of order k."""

    tokens: int
    words: int
    main_tokens: int
    mix: tuple[tuple[float, ...], ...]


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


# -- blocks -------------------------------------------------------------------


class _Builder:
    def __init__(self, deleted: bool):
        self.deleted, self.size = deleted, 0
        self.ids: dict[bytes, int] = {}
        self.docs: list[tuple] = []
        self.parts: list[np.ndarray] = []

    def add(self, doc_id, held: bool, text: bytes) -> None:
        ids, words = self.ids, lowered_words(text)
        tokens = np.empty(len(words) + 2, np.int32)
        tokens[0], tokens[-1] = START, END
        tokens[1:-1] = [ids.setdefault(w, len(ids) + 2) for w in words]
        self.parts.append(tokens)
        self.docs.append((doc_id, held, len(tokens)))
        self.size += len(text) + 16

    def row(self, block: int) -> dict:
        keys = [START_KEY, END_KEY, *(xxhash.xxh64_intdigest(w, 1) for w in self.ids)]
        doc_ids, held, lens = zip(*self.docs, strict=True)
        return {
            "block": block,
            "deleted": self.deleted,
            "doc_ids": doc_ids,
            "held": held,
            "lens": lens,
            "tokens": _pack(np.concatenate(self.parts)),
            "vocab": np.array(keys, np.uint64).tobytes(),
            "n_train": sum(n - 1 for _, h, n in self.docs if not h),
        }


def encode(docs: DataFrame, folds: int, fold: int, block_bytes: int) -> DataFrame:
    """Blocks of documents as token numbers. A block holds deleted documents only, or none."""
    held = crc_of("doc_id") % folds == fold
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held.alias("held"),
        (~held & (F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0)).alias("deleted"),
        text_bytes().alias("text"),
    )

    def blocks(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        building: dict[bool, _Builder] = {}
        schema = pa.schema(
            [
                ("block", pa.int64()),
                ("deleted", pa.bool_()),
                ("doc_ids", pa.list_(pa.int64())),
                ("held", pa.list_(pa.bool_())),
                ("lens", pa.list_(pa.int32())),
                ("tokens", pa.binary()),
                ("vocab", pa.binary()),
                ("n_train", pa.int64()),
            ]
        )
        for batch in batches:
            for i, h, deleted, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = building.setdefault(deleted, _Builder(deleted))
                b.add(i, h, text)
                if b.size >= block_bytes:
                    yield pa.RecordBatch.from_pylist([b.row(first + made)], schema)
                    made += 1
                    del building[deleted]
        for b in building.values():
            yield pa.RecordBatch.from_pylist([b.row(first + made)], schema)
            made += 1

    return rows.mapInArrow(blocks, BLOCK)


class _Grams:
    """The n-grams of a block.

    ``at[k]`` has, for each predicted position, the number of the n-gram of order k + 1 that ends there, or -1
    where the text began too recently; ``keys[k]`` their hashes; ``context[k]`` each one's n-gram of order k.
    """

    def __init__(self, row: dict, order: int):
        self.tokens = _unpack(row["tokens"], np.int32)
        self.lens = np.array(row["lens"], np.int64)
        self.doc = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
        self.predicted = self.tokens != START
        vocab = np.frombuffer(row["vocab"], np.uint64)
        place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        self.at, self.keys, self.context = [self.tokens], [vocab], [None]
        for k in range(1, order):
            below = self.at[-1]
            at = np.full(len(self.tokens), -1, np.int32)
            where = np.flatnonzero(place >= k)
            pairs = below[where - 1].astype(np.int64) * len(vocab) + self.tokens[where]
            found, at[where] = np.unique(pairs, return_inverse=True)
            self.context.append(found // len(vocab))
            last = vocab[found % len(vocab)]
            self.keys.append(mix(self.keys[-1][self.context[-1]] * np.uint64(2 * k + 1) + mix(last)))
            self.at.append(at)

    def questions(self, buckets: int):
        """For each order, the order in which its n-grams are asked, and where each bucket begins."""
        for keys in self.keys:
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((keys, bucket))
            yield by, np.searchsorted(bucket[by], np.arange(buckets + 1))

    def counted(self, k: int, chosen: np.ndarray) -> np.ndarray:
        at = self.at[k][chosen & (self.at[k] >= 0)]
        return np.bincount(at, minlength=len(self.keys[k])).astype(np.int32)


# -- counts -------------------------------------------------------------------


def _asked(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = _Grams(row, order)
                train = ~np.array(row["held"], bool)[grams.doc]
                for k, (by, begins) in enumerate(grams.questions(buckets)):
                    counts, keys = grams.counted(k, train)[by], grams.keys[k][by]
                    out: dict[str, list] = {c.split()[0]: [] for c in ASKED.split(", ")}
                    for b in np.flatnonzero(np.diff(begins)):
                        part = slice(begins[b], begins[b + 1])
                        out["bucket"].append(int(b))
                        out["block"].append(row["block"])
                        out["level"].append(k)
                        out["keys"].append(keys[part].tobytes())
                        out["main"].append(b"" if row["deleted"] else _pack(counts[part]))
                        out["dev"].append(_pack(counts[part]) if row["deleted"] else b"")
                    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out)
                    )

    return blocks.mapInArrow(ask, ASKED)


def _answers(asked: DataFrame) -> DataFrame:
    def answer(questions: pa.Table) -> pa.Table:
        out = []
        rows = questions.to_pylist()
        for level in sorted({r["level"] for r in rows}):
            own = [r for r in rows if r["level"] == level]
            keys = [np.frombuffer(r["keys"], np.uint64) for r in own]
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = {}
            for fold in ("main", "dev"):
                counts = [
                    _unpack(r[fold], np.int32) if r[fold] else np.zeros(len(k), np.int32)
                    for r, k in zip(own, keys, strict=True)
                ]
                total[fold] = np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)
            known = (total["main"] + total["dev"] > 0) & (found != np.uint64(START_KEY))
            begin = 0
            for i, (r, k) in enumerate(zip(own, keys, strict=True)):
                part = at[begin : begin + len(k)]
                begin += len(k)
                out.append(
                    {
                        "block": r["block"],
                        "level": level,
                        "bucket": r["bucket"],
                        "main": _pack(total["main"][part]),
                        "dev": _pack(total["dev"][part]),
                        "distinct": int(known.sum()) if level == 0 and i == 0 else 0,
                    }
                )
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        names = [c.split()[0] for c in ANSWER.split(", ")]
        return pa.Table.from_pylist(out, pa.schema(list(zip(names, kinds, strict=True))))

    return asked.groupBy("bucket").applyInArrow(answer, ANSWER)


def _filled(grams: _Grams, answers: list[dict], buckets: int) -> list[dict[str, np.ndarray]]:
    """The answered counts of a block's n-grams, in its own numbering."""
    out = []
    for k, (by, begins) in enumerate(grams.questions(buckets)):
        counts = {fold: np.zeros(len(by), np.int64) for fold in ("main", "dev")}
        for a in (a for a in answers if a["level"] == k):
            where = by[begins[a["bucket"]] : begins[a["bucket"] + 1]]
            for fold, c in counts.items():
                c[where] = _unpack(a[fold], np.int64)
        out.append(counts)
    return out


def bucket_of(seen: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two of its count."""
    return np.minimum(np.ceil(np.log2(seen + 1.0)), BUCKETS - 1).astype(np.int64)


def _levels(grams: _Grams, counts: list[np.ndarray], tokens: int, chosen: np.ndarray):
    """For each order, the estimate and the bucket of every chosen position."""
    for k, count in enumerate(counts):
        at = grams.at[k][chosen]
        if k == 0:
            yield count[at] / max(tokens, 1), np.ones(len(at), np.int64)
            continue
        here = at >= 0
        seen = counts[k - 1][grams.context[k]]
        estimate, bucket = np.zeros(len(at)), np.zeros(len(at), np.int64)
        estimate[here] = (count / np.maximum(seen, 1))[at[here]]
        bucket[here] = bucket_of(seen)[at[here]]
        yield estimate, bucket


def _mixed(levels, weights, words: int) -> np.ndarray:
    p = None
    for k, (estimate, bucket) in enumerate(levels):
        w = np.array(weights[k])[bucket]
        p = w * estimate + (1 - w) * (1.0 / (words + 1) if p is None else p)
    return p


# -- expectation-maximisation ---------------------------------------------------


def _deleted_rows(blocks, answers, order, buckets, main_tokens) -> DataFrame:
    """Of every deleted document's n-gram: its estimates without those documents, and how often it occurs."""

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            grams = _Grams(row, order)
            counts = [c["main"] for c in _filled(grams, right.to_pylist(), buckets)]
            # One row stands for all positions with the same n-grams of every order.
            top = np.zeros(len(grams.tokens), np.int64)
            for at in grams.at:
                top = np.unique(top * (int(at.max(initial=0)) + 2) + at + 1, return_inverse=True)[1]
            _, first, times = np.unique(
                top[grams.predicted], return_index=True, return_counts=True
            )
            chosen = np.flatnonzero(grams.predicted)[first]
            estimates, levels = zip(*_levels(grams, counts, main_tokens, chosen), strict=True)
            out.append(
                {
                    "n": len(chosen),
                    "estimates": _pack(np.concatenate(estimates).astype(np.float32)),
                    "levels": _pack(np.concatenate(levels).astype(np.uint8)),
                    "times": _pack(times.astype(np.int32)),
                }
            )
        kinds = [("n", pa.int64()), *((c, pa.binary()) for c in ("estimates", "levels", "times"))]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    return (
        blocks.filter("deleted")
        .groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(rows, "n bigint, estimates binary, levels binary, times binary")
    )


def _em_step(rows: DataFrame, weights: list[list[float]], words: int) -> list[list[float]]:
    """One step: the share of each order among the tokens that reached it, by bucket."""
    order = len(weights)

    def expected(batches):
        used, reached = np.zeros((order, BUCKETS)), np.zeros((order, BUCKETS))
        for batch in batches:
            for r in batch.to_pylist():
                f = _unpack(r["estimates"], np.float32).reshape(order, -1).astype(float)
                b = _unpack(r["levels"], np.uint8).reshape(order, -1)
                times = _unpack(r["times"], np.int32)
                own, p = [], np.full(len(times), 1.0 / (words + 1))
                for k in range(order):
                    w = np.array(weights[k])[b[k]]
                    below, p = p, w * f[k] + (1 - w) * p
                    own.append(np.divide(w * f[k], p, out=np.zeros(len(p)), where=p > 0))
                    del below
                arrived = times.astype(float)
                for k in reversed(range(order)):
                    reached[k] += np.bincount(b[k], arrived, BUCKETS)
                    used[k] += np.bincount(b[k], arrived * own[k], BUCKETS)
                    arrived = arrived * (1 - own[k])
        k, b = np.nonzero(reached)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(used[k, b]), pa.array(reached[k, b])],
            ["k", "b", "used", "reached"],
        )

    sums = (
        rows.mapInArrow(expected, "k int, b int, used double, reached double")
        .groupBy("k", "b")
        .agg(F.sum("used").alias("used"), F.sum("reached").alias("reached"))
        .collect()
    )
    new = [list(w) for w in weights]
    for r in sums:
        # Some mass always stays below, so that a text with unseen words keeps a probability.
        new[r["k"]][r["b"]] = round(min(r["used"] / r["reached"], 1 - 1e-4), 6) if r["b"] else 0.0
    return new


def learn(rows: DataFrame, order: int, words: int, steps: int) -> tuple[tuple[float, ...], ...]:
    """The weights; where nothing was deleted they stay at one half. Bucket 0 (unseen) always has weight 0."""
    weights = [[0.0] + [0.5] * (BUCKETS - 1) for _ in range(order)]
    for _ in range(steps):
        new = _em_step(rows, weights, words)
        moved = max(abs(a - b) for x, y in zip(new, weights, strict=True) for a, b in zip(x, y, strict=True))
        weights = new
        if moved < 1e-3:
            break
    return tuple(map(tuple, weights))


# -- scores -------------------------------------------------------------------


def _scores(blocks, answers, order, buckets, model: Weights) -> DataFrame:
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            grams = _Grams(row, order)
            counts = [c["main"] + c["dev"] for c in _filled(grams, right.to_pylist(), buckets)]
            at = np.flatnonzero(grams.predicted)
            doc, n = grams.doc[at], len(grams.lens)
            seen = counts[0][grams.tokens[at]]
            p = _mixed(_levels(grams, counts, model.tokens, at), model.mix, model.words)
            base = np.log10((seen + 1) / (model.tokens + model.words + 1))
            tables.append(
                pa.table(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "held_out": pa.array(row["held"], pa.bool_()),
                        "n_tokens": pa.array(grams.lens - 1),
                        "n_known": pa.array(np.bincount(doc, seen > 0, n).astype(np.int64)),
                        "train_tokens": pa.array(np.full(n, model.tokens, np.int64)),
                        "base_score": pa.array(np.bincount(doc, base, n)),
                        "score": pa.array(np.bincount(doc, np.log10(p), n)),
                    }
                )
            )
        return pa.concat_tables(tables)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)


def score_documents(
    docs: DataFrame,
    order: int = 2,
    folds: int = 7,
    fold: int = 2,
    em_steps: int = 12,
    block_bytes: int = 10 << 20,
    bucket_tokens: int = 3_000_000,
) -> DataFrame:
    """Scores every document; learns from those outside ``fold``.

    ``block_bytes`` bounds the text that a task holds at once (one longer document is a block of its own), and
    ``bucket_tokens`` the tokens whose n-grams meet in one counting task.
    """
    blocks = stored(encode(docs, folds, fold, block_bytes), "lm-blocks")
    sizes = blocks.agg(
        F.sum("n_train").alias("train"),
        F.sum(F.when(~F.col("deleted"), F.col("n_train"))).alias("main"),
        F.sum(F.aggregate("lens", F.lit(0).cast("bigint"), lambda s, n: s + n)).alias("all"),
    ).first()
    buckets = max(8, -(-(sizes["all"] or 0) // bucket_tokens))
    answers = stored(_answers(_asked(blocks, order, buckets)), "lm-counts")
    words = answers.agg(F.sum("distinct")).first()[0] or 0
    main = sizes["main"] or 0
    rows = stored(_deleted_rows(blocks, answers, order, buckets, main), "lm-deleted")
    model = Weights(sizes["train"] or 0, words, main, learn(rows, order, words, em_steps))
    return _scores(blocks, answers, order, buckets, model)
