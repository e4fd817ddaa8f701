"""SimHash near duplicates by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to 16 fixed reference fingerprints. Two fingerprints
within ``radius`` bits differ by at most ``radius`` in each of these coordinates, so a pair whose largest
coordinate difference exceeds it is discarded; only survivors are compared bit by bit.

Distances to references lie close together, so they can't say by themselves which rows should meet in a task.
That is done by cells: the 64 bits are cut into ``radius + s`` segments, of which ``s`` must be equal in a pair
that links, and a fingerprint is placed in the cell of each choice of s segments. ``s`` grows with the number of
fingerprints so that cells stay small; each choice finds every link. Within a cell, rows are sorted by the
first coordinate and visited in growing distance of their ranks until that coordinate differs too much. A cell
of more than ``cell_rows`` rows is cut into parts by hash, and every two parts meet in a task of their own. A cell
gives a forest of links, not all pairs, and never more links than rows.

Copies share a fingerprint, and only distinct fingerprints take part, so large groups of copies cost nothing
here. Components are found by ``components``.

Nulls and texts without words have fingerprint 0, which links like any other. ``near_duplicates`` returns repeated
rows as often as they come. A null ``doc_id`` is never a component's id unless all its documents have none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import MASK, lowered_words, stored, text_bytes, unwrapped, wrapped
from chainage.llm.components import components

SHINGLE, SEED, RADIUS, PIVOTS = 4, 42, 4, 16


def pivots(n: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints: hashes of 1, 2, ..."""
    return [xxhash.xxh64_intdigest(str(i + 1).encode(), SEED) for i in range(n)]


def fingerprint(text: bytes) -> int:
    words = lowered_words(text)
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    joined = [b" ".join(words[i : i + SHINGLE]) for i in range(n)]
    ones = np.zeros(64, np.int64)
    for begin in range(0, n, 1 << 16):
        part = joined[begin : begin + (1 << 16)]
        h = np.fromiter((digest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """``doc_id, fp`` of every row, and ``key`` if one is given; ``fp`` is the fingerprint as a signed number."""

    def made(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp.view(np.int64)), *batch.columns[1:]], ["fp", *batch.schema.names[1:]]
            )

    own = [] if key is None else [key.cast("string").alias("key")]
    rows = docs.select(text_bytes().alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), *own)
    return rows.mapInArrow(made, "fp bigint, doc_id bigint" + (", key string" if own else ""))


def pivot_table(fps: DataFrame) -> DataFrame:
    """Adds ``near``: the Hamming distances to all pivots, a byte each."""
    distances = [
        F.substring(F.hex(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p - (1 << 64) if p >> 63 else p)))), -2, 2)
        for p in pivots()
    ]
    return fps.withColumn("near", F.unhex(F.concat(*[F.lpad(d, 2, "0") for d in distances])))


def segments(count: int, radius: int, cell_rows: int) -> list[int]:
    """Masks of the segments: as few as keep the expected cell within ``cell_rows`` rows."""
    for more in range(1, 6):
        m = radius + more
        edges = [round(64 * i / m) for i in range(m + 1)]
        bits = sum(sorted(b - a for a, b in zip(edges, edges[1:], strict=False))[:more])
        if count / 2**bits <= cell_rows:
            break
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _cells(masks: list[int], radius: int) -> Column:
    """The cell numbers of a fingerprint: a hash of each choice's number and bits."""
    out = []
    for i, chosen in enumerate(combinations(masks, len(masks) - radius)):
        mask = sum(chosen) & MASK
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed))))
    return F.array(*out)


def forest(task: np.ndarray, fp: np.ndarray, near: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal ``task``: each fingerprint that links, and the one it is led to."""
    order = np.lexsort((fp, near[:, 0], task))
    task, fp, near = task[order], fp[order], near[order].astype(np.int16)
    root = np.arange(len(fp))
    left, step = root[:-1], 1
    while len(left):
        right = left + step
        close = (task[right] == task[left]) & (near[right, 0] - near[left, 0] <= radius)
        left, right = left[close], right[close]
        # Pairs that are connected already add nothing.
        i = np.flatnonzero(root[left] != root[right])
        for k in range(1, near.shape[1]):
            if not len(i):
                break
            i = i[np.abs(near[left[i], k] - near[right[i], k]) <= radius]
        i = i[np.bitwise_count(fp[left[i]] ^ fp[right[i]]) <= radius]
        a, b = left[i], right[i]
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        step += 1
        left = left[left + step < len(fp)]
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def links(fps: DataFrame, radius: int = RADIUS, cell_rows: int = 64, part_rows: int = 4096) -> DataFrame:
    """``a, b``: a forest that connects all distinct ``fp`` within ``radius`` bits, directly or over others."""
    count = fps.count()
    masks = segments(count, radius, cell_rows)
    placed = pivot_table(fps).withColumn("cell", F.explode(_cells(masks, radius)))
    large = (
        placed.groupBy("cell").count().filter(F.col("count") > part_rows)
        .select("cell", F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts)
    # Part p of a large cell goes to the tasks (p, q) and (q, p) for all q; others have one task.
    paired = F.transform(
        F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint")),
        lambda q: F.xxhash64("cell", F.least(own, q), F.greatest(own, q)),
    )
    tasks = placed.join(large, "cell", "left").select(F.explode(paired).alias("task"), "fp", "near")
    shards = max(8, -(-count * len(list(combinations(masks, radius))) // 200_000))

    def within(rows: pa.Table) -> pa.Table:
        near = np.frombuffer(b"".join(rows["near"].to_pylist()), np.uint8).reshape(-1, PIVOTS)
        fp = rows["fp"].to_numpy().view(np.uint64)
        a, b = forest(rows["task"].to_numpy(), fp, near, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    shard = F.pmod(F.xxhash64("task"), F.lit(shards)).alias("shard")
    return (
        tasks.select(shard, "task", "fp", "near")
        .groupBy("shard")
        .applyInArrow(within, "a bigint, b bigint")
    )


def _members(distinct: DataFrame, radius: int) -> DataFrame:
    """``distinct`` with ``head``, one fingerprint of its component, instead of all links."""
    found = components(stored(links(distinct.select("fp"), radius), "pairs"))
    return distinct.join(found, distinct["fp"] == found["u"], "left").select(
        "fp", "least", F.coalesce("v", "fp").alias("head")
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    member = _members(distinct, radius)
    heads = member.groupBy("head").agg(F.min("least").alias("component_id"))
    named = member.join(heads, "head").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, that with its smallest id; a null id comes after all others.

    Rows are told apart by id and text, so texts that differ too much are both kept if they share an id or have none.
    Of rows that agree in both, one is kept.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("null")), F.md5(text_bytes()))
    rows = fingerprints(docs, key)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    distinct = stored(rows.groupBy("fp").agg(F.min(rank).alias("least")), "distinct")
    heads = _members(distinct, radius).groupBy("head").agg(F.min("least").alias("least"))
    # The join and the choice among repeated rows share one shuffle of the texts.
    kept = heads.select(F.col("least.key").alias("id"))
    chosen = wrapped(docs, key.alias("id")).join(kept, "id", "left_semi").dropDuplicates(["id"])
    return unwrapped(chosen, docs.columns)
