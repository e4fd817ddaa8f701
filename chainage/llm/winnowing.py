"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-gram hashes the smallest is kept (equal ones all), on both sides. Two
texts that share ``window`` words then share a kept hash at the same place of the shared span, so the join on
hashes misses none. Every joined pair is extended word by word to both sides, by at most ``window - k`` words,
which is as far as windows around this place can reach; spans of ``window`` equal words or more are hits. Items
shorter than ``window`` are windows of their own length: documents keep the hashes of all spans of the lengths
that occur (at most ``window - 1`` different ones).

Only kept hashes that pass a Bloom filter over the benchmark's hashes leave the scan. The filter has a fixed
size whatever the benchmark's size; if it fills up, more hashes pass and the join drops them.

Rows are identified by a digest of ``doc_id`` and text, so ids may be null or repeated; rows that agree in both
share their result. A null or empty text has no words and no hits. An item without words is no window; a
null ``item_id`` is listed as ``null``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import WordHashes, alnum_words, gram_hashes, row_key, stored, text_bytes, unwrapped, wrapped

WINDOW, K = 13, 5
FILTER_BITS = 1 << 23
_ANCHOR = "struct<size:int,hash:bigint,pos:int,before:array<string>,span:array<string>,after:array<string>>"


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the smallest of some w consecutive ones."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = hashes[:n].copy()
    for j in range(1, w):
        np.minimum(least, hashes[j : j + n], out=least)
    reach = np.zeros(len(hashes), np.uint64)
    for j in range(w):
        np.maximum(reach[j : j + n], least, out=reach[j : j + n])
    return np.flatnonzero(reach == hashes)


def _kept(words: np.ndarray, lengths, window: int, k: int):
    """``(size, hashes, places)``: the winnowed k-grams (size 0), and all spans of the given lengths."""
    if len(words) >= window:
        h = gram_hashes(words, k)
        places = winnowed(h, window - k + 1)
        yield 0, h[places], places
    for size in lengths:
        h = gram_hashes(words, size)
        yield size, h, np.arange(len(h))


def _slots(size: int, hashes: np.ndarray) -> np.ndarray:
    """Two bits of the filter for every hash."""
    h = hashes + np.uint64(size)
    return np.stack([h % np.uint64(FILTER_BITS), (h >> np.uint64(32)) % np.uint64(FILTER_BITS - 1)]).astype(np.int64)


def _anchor(words, places, size, hashes, window, k):
    n = size or k
    for h, p in zip(hashes.view(np.int64).tolist(), places.tolist(), strict=True):
        around = 0 if size else window - k
        yield {
            "size": size,
            "hash": h,
            "pos": p,
            # Nearest word first.
            "before": [w.decode() for w in reversed(words[max(0, p - around) : p])],
            "span": [w.decode() for w in words[p : p + n]],
            "after": [w.decode() for w in words[p + n : p + n + around]],
        }


def _item_anchors(items: DataFrame, window: int, k: int) -> DataFrame:
    def anchors(batches):
        hashes = WordHashes(5)
        for batch in batches:
            out = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = alnum_words(text)
                lengths = [len(words)] if 0 < len(words) < window else []
                for size, h, places in _kept(hashes.of(words), lengths, window, k):
                    out += [{"item": item, "anchor": a} for a in _anchor(words, places, size, h, window, k)]
            yield pa.RecordBatch.from_pylist(out, _item_schema())

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), text_bytes().alias("text"))
    return rows.mapInArrow(anchors, f"item string, anchor {_ANCHOR}")


def _anchor_type():
    text = pa.list_(pa.string())
    names = [("size", pa.int32()), ("hash", pa.int64()), ("pos", pa.int32())]
    return pa.struct([*names, ("before", text), ("span", text), ("after", text)])


def _item_schema():
    return pa.schema([("item", pa.string()), ("anchor", _anchor_type())])


def _filter(anchors: DataFrame) -> np.ndarray:
    """The Bloom filter: one bitmap of fixed size from each of at most 8 tasks."""

    def bitmap(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            sizes, hashes = (c.to_numpy() for c in batch.columns)
            for size in np.unique(sizes):
                bits[_slots(int(size), hashes[sizes == size].view(np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], ["bits"])

    rows = anchors.select("anchor.size", "anchor.hash").distinct().coalesce(8)
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows.mapInArrow(bitmap, "bits binary").collect():
        bits |= np.frombuffer(r["bits"], np.uint8)
    return bits


def _document_anchors(docs: DataFrame, bits: np.ndarray, lengths: list[int], window: int, k: int) -> DataFrame:
    def anchors(batches):
        hashes = WordHashes(5)
        passes = np.unpackbits(bits).astype(bool)
        schema = pa.schema(
            [("key", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("anchors", pa.list_(_anchor_type()))]
        )
        for batch in batches:
            out = []
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = alnum_words(text)
                found = []
                for size, h, places in _kept(hashes.of(words), lengths, window, k):
                    i = np.flatnonzero(passes[_slots(size, h)].all(0))
                    found += _anchor(words, places[i], size, h[i], window, k)
                out.append({"key": key, "doc_id": doc_id, "n_words": len(words), "anchors": found})
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = docs.select(
        row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")
    )
    return rows.mapInArrow(anchors, f"key binary, doc_id bigint, n_words bigint, anchors array<{_ANCHOR}>")


def _alike(a, b):
    """How many words agree from the start of two arrays."""
    pairs = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.coalesce(F.nullif(F.array_position(pairs, F.lit(False)), F.lit(0)) - 1, F.size(pairs))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``key, doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row for each of ``docs``.

    A document is contaminated if it has hits and a twentieth of its words or more are hit.
    """
    wanted = stored(_item_anchors(items, window, k), "benchmark-anchors")
    lengths = [r[0] for r in wanted.select("anchor.size").filter("size > 0").distinct().orderBy("size").collect()]
    found = stored(_document_anchors(docs, _filter(wanted), lengths, window, k), "document-anchors")

    # Copies of a row have equal anchors; the hits are worked out once for each key.
    theirs = found.filter(F.size("anchors") > 0).dropDuplicates(["key"]).select("key", F.explode("anchors").alias("d"))
    theirs = theirs.select("key", F.col("d.size").alias("size"), F.col("d.hash").alias("hash"), "d")
    ours = wanted.select(F.col("anchor.size").alias("size"), F.col("anchor.hash").alias("hash"), "item", F.col("anchor").alias("b"))
    before, after = _alike("d.before", "b.before"), _alike("d.after", "b.after")
    spans = (
        theirs.join(ours, ["size", "hash"])
        .filter("d.span = b.span")
        .select("key", "item", "size", before.alias("before"), after.alias("after"), F.col("d.pos").alias("pos"))
        .withColumn("n", F.when(F.col("size") > 0, F.col("size")).otherwise(F.lit(k) + F.col("before") + F.col("after")))
        .filter((F.col("size") > 0) | (F.col("n") >= window))
        .select("key", "item", (F.col("pos") - F.col("before")).alias("start"), "n")
    )
    spans = stored(spans.distinct(), "hit-spans")
    ordered = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    covered = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["start"]))).alias("n"),
            F.greatest(s["end"], x["end"]).cast("bigint").alias("end"),
        ),
    )["n"]
    hits = spans.groupBy("key").agg(covered.alias("n_hit"))
    per_item = spans.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        found.drop("anchors")
        .join(hits.join(per_item, "key"), "key", "left")
        .select(
            "key",
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.size(listed).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, items, window, k).filter("contaminated").select(F.col("key").alias("__key")).distinct()
    rows = wrapped(docs, row_key("doc_id", "text").alias("__own"))
    return unwrapped(rows.join(bad, F.col("__own") == F.col("__key"), "left_anti"), docs.columns)
