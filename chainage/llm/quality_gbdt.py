"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a whole text are counted from its byte histogram, its words and its lines. Trees are grown
level by level from histograms of at most 64 quantile bins and laid out as complete binary trees in flat
arrays (feature, threshold, value), which numpy walks for a batch of documents at once: one step per level.

The model is fitted on the driver on a bounded sample: of the usable labels, the ``sample_rows`` with the
smallest hash of their id. Everything else is a map over all documents; nothing is shuffled but the sample.

Null and empty texts have all statistics 0 and are scored like others. Labels that are null, or whose id is
null, are left out; contradicting labels of one id count by their mean. If no label is usable, or all are
equal, the score is their mean (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import crc_of, text_bytes

FEATURES = (
    "log_bytes upper lower digit blank non_ascii exclaim symbols bars stops commas other"
    " entropy log_words word_len distinct top_word long_words upper_words stuck_words"
    " log_lines repeated_lines line_len bar_lines repeated_words"
).split()
_BYTE = np.arange(256)
_CLASSES = [
    (_BYTE >= 65) & (_BYTE <= 90),
    (_BYTE >= 97) & (_BYTE <= 122),
    (_BYTE >= 48) & (_BYTE <= 57),
    (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)),
    _BYTE >= 128,
    _BYTE == ord("!"),
    np.isin(_BYTE, list(b"#*$%&<>")),
    _BYTE == ord("|"),
    np.isin(_BYTE, list(b".?")),
    np.isin(_BYTE, list(b",;:")),
]
_CLASSES.append(~np.logical_or.reduce(_CLASSES))
_CLASSES = np.array(_CLASSES, float)


def statistics(text: bytes) -> np.ndarray:
    """The features of one text, in the order of FEATURES."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / len(text)
    out[0] = np.log1p(len(text))
    out[1:12] = _CLASSES @ share
    some = share[share > 0]
    out[12] = -(some * np.log2(some)).sum()
    words = text.split()
    if words:
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        out[13] = np.log1p(n)
        out[14] = lens.mean()
        out[15] = len(seen) / n
        out[16] = max(seen.values()) / n
        out[17] = (lens > 15).mean()
        upper = stuck = 0
        for w, c in seen.items():
            upper += c * w.isupper()
            stuck += c * (w[-1] in b"!#*$%&|")
        out[18], out[19] = upper / n, stuck / n
        out[24] = sum(c for c in seen.values() if c > 1) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    if lines:
        out[20] = np.log1p(len(lines))
        out[21] = 1 - len(set(lines)) / len(lines)
        out[22] = np.log1p(len(text) / len(lines))
        out[23] = sum(x.rstrip().endswith(b"|") for x in lines) / len(lines)
    return out


@dataclass(frozen=True)
class Trees:
    """A complete tree of ``depth`` levels per row: node i has the children 2i + 1 and 2i + 2."""

    depth: int
    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, bins: int = 64) -> Trees:
    """Boosts logistic loss; ``y`` may hold means between 0 and 1."""
    inner = 2**depth - 1
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        none = np.zeros((0, inner))
        return Trees(depth, start, none.astype(int), none, np.zeros((0, inner + 1)))
    n, width = x.shape
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
    cell = binned + np.arange(width) * bins
    total = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + cell).ravel()
            shape = (nodes, width, bins)
            gs = np.bincount(at, np.repeat(g, width), nodes * width * bins).reshape(shape).cumsum(2)
            hs = np.bincount(at, np.repeat(h, width), nodes * width * bins).reshape(shape).cumsum(2)
            ns = np.bincount(at, minlength=nodes * width * bins).reshape(shape).cumsum(2)
            g_all, h_all, n_all = gs[..., -1:], hs[..., -1:], ns[..., -1:]
            gain = gs**2 / (hs + 1) + (g_all - gs) ** 2 / (h_all - hs + 1) - g_all**2 / (h_all + 1)
            gain[(ns < 20) | (n_all - ns < 20)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for i in np.flatnonzero(gain.reshape(nodes, -1).max(1) > 1e-6):
                f, b = divmod(int(best[i]), bins)
                feature[first + i], threshold[first + i] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(depth, start, np.array(features), np.array(thresholds), np.array(values))


def _sample(docs: DataFrame, labels: DataFrame, folds: int, fold: int, rows: int):
    """Statistics and labels of the sample, in the order of the ids' hashes."""
    usable = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .filter("doc_id is not null and quality is not null")
        .filter(crc_of("doc_id") % folds != fold)
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("quality"))
    )
    # The sample is at most ``rows`` ids, whatever the size of the tables.
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def measured(batches):
        for batch in batches:
            ids, quality, texts = (c.to_pylist() for c in batch.columns)
            x = [statistics(t).astype(np.float32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(quality, pa.float64()), pa.array(x, pa.binary())],
                ["doc_id", "quality", "x"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    found = (
        texts.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", "text")
        .mapInArrow(measured, "doc_id bigint, quality double, x binary")
        .groupBy("doc_id")
        .agg(F.min(F.struct("x", "quality")).alias("row"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .select("row.x", "row.quality")
        .toArrow()
    )
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, len(FEATURES))
    return x.astype(float), np.array(found["quality"].to_pylist(), float)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 3,
    fold: int = 1,
    sample_rows: int = 20_000,
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.15,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; labels in ``fold`` are never learnt from."""
    trees = fit(*_sample(docs, labels, folds, fold, sample_rows), rounds, depth, rate)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (crc_of("doc_id") % folds == fold).alias("held_out"),
        text_bytes().alias("text"),
    )

    def scored(batches):
        for batch in batches:
            x = [statistics(t).astype(np.float32) for t in batch.column(2).to_pylist()]
            score = trees.score(np.array(x, float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(scored, "doc_id bigint, held_out boolean, score double, predicted int")
