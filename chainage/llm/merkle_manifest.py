"""Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, and a proof for every row.

Leaves are numbered within their group by a range partitioning and the rows' places in the files it writes, so that no task
holds a group. Every level of a tree is one equijoin of its nodes with themselves on the index of the sibling (the last bit
flipped if nodes have two children, else the place shifted within the run); the rows in place 0 then emit the parents. Levels
are written to the shared folder, with the siblings found. Proofs are joined from the top down, once per level: above
``SHARED`` levels a path belongs to many leaves and is kept once, below it a leaf gathers a short list of its own.

H is the lower-case hexadecimal SHA-256 of its inputs in a row, digests as hexadecimal text. A field is ``-`` if null, else its
number of UTF-8 bytes, a colon and the value. A run that lacks siblings is hashed all the same, and a group of one leaf is its
own root. Groups ascend by the bytes of their name, null first; leaves ascend by the order column, null first, and rows that
share its value by their digest, so that the tree doesn't depend on where rows lie. Repeated rows are leaves like others.
An empty table has an empty manifest. Other columns, of any name, are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from chainage.llm.common import stored, work_path

#: Below this level every leaf carries its own siblings; above it a path serves 64 leaves and more.
SHARED = 6
NODE = ("grp", "idx", "nodes", "h")
PATH = "array<struct<place:int,others:binary>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """H of the fields, in binary."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def group_key(value: Column) -> Column:
    """Ascends like the UTF-8 bytes of the value, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``idx``, the place of a row in its ``grp`` by ``order`` (null first), and ``nodes``, the rows of the group.

    A range partitioning sorts all rows; a row's place in its file, and the rows of the group in the files before, give its number.
    Equal rows may be dealt to several tasks. The tables of counts have a row per group and file.
    """
    spark = rows.sparkSession
    path = work_path(spark, "ordered")
    (
        rows.withColumn("tie", F.col("_metadata.row_index"))
        .repartitionByRange("grp", *order, "tie")
        .sortWithinPartitions("grp", *order, "tie")
        .withColumn("part", F.spark_partition_id())
        .drop("tie")
        .write.option("maxRecordsPerFile", 0)
        .parquet(path)
    )
    laid = spark.read.schema(StructType([*rows.schema, StructField("part", IntegerType())])).parquet(path).withColumn("row", F.col("_metadata.row_index"))
    counts = laid.groupBy("grp", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    by_part = Window.partitionBy("grp").orderBy("part")
    before = F.sum("n").over(by_part) - F.col("n")
    whole = F.sum("n").over(Window.partitionBy("grp"))
    offsets = stored(counts.select("grp", "part", (before - F.col("first")).alias("shift"), whole.alias("nodes")), "offsets")
    return laid.join(offsets, ["grp", "part"]).withColumn("idx", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Adds ``place`` in the run and ``others``, the digests of the run's other nodes from left to right, in a row."""
    place = F.pmod(F.col("idx"), F.lit(fanout)).cast("int")
    out = nodes.withColumn("place", place)
    right = nodes.select("grp", "idx", "h")
    found = []
    for shift in range(1, fanout):
        other = (F.col("place") + shift) % fanout
        at = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - F.col("place") + other
        near = right.select(F.col("grp").alias("g"), F.col("idx").alias("i"), F.col("h").alias(f"h{shift}"))
        out = out.withColumn("at", at).join(near, (F.col("grp") == F.col("g")) & (F.col("at") == F.col("i")), "left")
        out = out.drop("g", "i", "at")
        found.append(F.struct(other.alias("place"), F.col(f"h{shift}").alias("h")))
    ordered = F.array_sort(F.filter(F.array(*found), lambda s: s["h"].isNotNull()))
    joined = F.unhex(F.concat_ws("", F.transform(ordered, lambda s: F.hex(s["h"]))))
    return out.withColumn("others", joined).drop(*[f"h{shift}" for shift in range(1, fanout)])


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """The next level, emitted by the rows in place 0; groups of one node are finished."""
    above = F.unhex(F.sha2(F.concat(hex_text(F.col("h")), hex_text(F.col("others"))).cast("binary"), 256))
    return level.where("place = 0 and nodes > 1").select(
        "grp",
        (F.col("idx") / fanout).cast("bigint").alias("idx"),
        F.ceil(F.col("nodes") / fanout).cast("bigint").alias("nodes"),
        above.alias("h"),
    )


@dataclass(frozen=True)
class Tree:
    """The levels of all groups' trees, written; ``roots`` has ``grp, h, height``."""

    levels: list[DataFrame]
    roots: DataFrame
    fanout: int


def grown(leaves: DataFrame, fanout: int) -> Tree:
    """``leaves`` has the columns of NODE and maybe more, which stay with the lowest level."""
    levels = [stored(with_siblings(leaves, fanout), "level-0")]
    most, height = levels[0].agg(F.max("nodes")).first()[0] or 0, 0
    roots = [levels[0].where("nodes = 1").select("grp", "h", F.lit(0).alias("height"))]
    while most > 1:
        up = parents(levels[-1], fanout)
        most, height = -(-most // fanout), height + 1
        # A level of one node a group holds roots alone.
        roots.append(up.where("nodes = 1").select("grp", "h", F.lit(height).alias("height")))
        if most > 1:
            levels.append(stored(with_siblings(up.where("nodes > 1"), fanout), f"level-{height}"))
    found = roots[0]
    for more in roots[1:]:
        found = found.union(more)
    return Tree(levels, stored(found, "roots"), fanout)


def _own() -> Column:
    """The entry of a node in its path; none where it has no sibling and stands alone as a root."""
    entry = F.array(F.struct(F.col("place").alias("place"), F.col("others").alias("others")))
    return F.when(F.col("nodes") > 1, entry).otherwise(F.array().cast(PATH))


def _below(tree: Tree, nodes: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
    """``nodes`` with the path of their parents put behind their own entry."""
    up = above.select(F.col("grp").alias("g"), F.col("idx").alias("i"), F.col("path").alias("rest"))
    at = (F.col("idx") / tree.fanout).cast("bigint")
    joined = nodes.join(up, (F.col("grp") == F.col("g")) & (at == F.col("i")), "left")
    path = F.concat(_own(), F.coalesce(F.col("rest"), F.array().cast(PATH)))
    return joined.select("grp", "idx", *keep, path.alias("path"))


def proofs(tree: Tree, top: DataFrame, keep: list[str]) -> DataFrame:
    """The leaves with ``keep``, ``path`` (entries from the leaf to the overall root) and ``subroot``.

    ``top`` has ``grp, h, height`` and ``rest``, the path of every group's root.
    """
    shared = min(SHARED, len(tree.levels))
    roots = top.select("grp", F.lit(0).cast("bigint").alias("idx"), F.col("rest").alias("path"), F.col("h").alias("subroot"), "height")
    # Highest first; a group joins the chain at the level at which it has one node.
    chain = roots.where(F.col("height") >= len(tree.levels)).drop("height")
    for height in range(len(tree.levels) - 1, shared - 1, -1):
        up = chain.select(
            F.col("grp").alias("g"), F.col("idx").alias("i"), F.col("path").alias("rest"), F.col("subroot")
        )
        at = (F.col("idx") / tree.fanout).cast("bigint")
        level = tree.levels[height].join(up, (F.col("grp") == F.col("g")) & (at == F.col("i")))
        chain = level.select("grp", "idx", F.concat(_own(), F.col("rest")).alias("path"), "subroot").union(
            roots.where(F.col("height") == height).drop("height")
        )
        if (len(tree.levels) - height) % 8 == 0:
            chain = stored(chain, "paths")
    if shared < len(tree.levels):
        chain = chain.union(roots.where(F.col("height") < shared).drop("height"))
    else:
        chain = chain.union(roots.where(F.col("height") < len(tree.levels)).drop("height"))
    low = None
    for height in range(shared - 1, -1, -1):
        level, more = tree.levels[height], keep if height == 0 else []
        low = _below(tree, level, low, more) if low is not None else level.select("grp", "idx", *more, _own().alias("path"))
    far = chain.select(F.col("grp").alias("g"), F.col("idx").alias("i"), F.col("path").alias("rest"), "subroot")
    at = F.floor(F.col("idx") / F.lit(tree.fanout**shared)).cast("bigint")
    return low.join(far, (F.col("grp") == F.col("g")) & (at == F.col("i"))).select(
        *keep, F.concat("path", "rest").alias("path"), "subroot"
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hexadecimal) and the siblings of its path lead to."""

    def step(h: Column, entry: Column) -> Column:
        others = hex_text(entry["others"])
        cut = entry["place"] * 64
        return F.sha2(F.concat(others.substr(F.lit(1), cut), h, others.substr(cut + 1, F.length(others))).cast("binary"), 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda e: hex_text(e["others"]))).cast("binary"), 256)


def manifest(docs: DataFrame, fields: list[Column], group: Column, order: Column, keep: dict[str, Column], fanout: int = 2) -> DataFrame:
    """A row per row of ``docs``: ``keep``, ``leaf``, ``subroot`` and ``root`` (hexadecimal) and ``path``.

    ``fields`` make the leaf, ``group`` names its tree, ``order`` its place there. ``keep`` are columns to carry along,
    which must depend on nothing but the row's fields.
    """
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    carried = [c.alias(f"keep_{i}") for i, c in enumerate(keep.values())]
    names = [f"keep_{i}" for i in range(len(keep))]
    # Texts are read once; from here on rows are a few digests wide.
    leaves = stored(docs.select(group_key(group).alias("grp"), order.alias("place_by"), digest(*fields).alias("h"), *carried), "leaves")
    ranked = numbered(leaves, "place_by", "h").drop("place_by")
    tree = grown(ranked, fanout)
    groups = stored(tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h"), "subroots")
    over = grown(numbered(groups, "name"), fanout)
    whole = over.roots.first()
    empty = F.array().cast(PATH)
    top_roots = over.roots.withColumn("rest", empty)
    rest = proofs(over, top_roots, ["name"]).select("name", F.col("path").alias("rest"))
    top = stored(tree.roots.join(rest, F.col("grp") == F.col("name")).drop("name"), "tops")
    found = proofs(tree, top, [*names, "h"])
    return found.select(
        *[F.col(n).alias(name) for n, name in zip(names, keep, strict=True)],
        hex_text(F.col("h")).alias("leaf"),
        hex_text(F.col("subroot")).alias("subroot"),
        F.lit(whole["h"].hex() if whole else None).cast("string").alias("root"),
        "path",
    )


def checked_documents(docs: DataFrame, every: int = 7) -> DataFrame:
    """The manifest of documents, and for every row whether its proof holds after one in ``every`` was tampered with."""
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    plain = [F.col(n) for n in names]
    # One more than the largest 64-bit number is still a number here.
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    forged = [more if n == "n_chars" else F.col(n) for n in names]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    keep = {
        "doc_id": F.col("doc_id").cast("bigint"),
        "forged": F.when(touched & F.col("n_chars").isNotNull(), digest(*forged)),
    }
    rows = manifest(docs, plain, F.col("lang"), F.col("doc_id"), keep)
    shown = F.coalesce(hex_text(F.col("forged")), F.col("leaf"))
    out = rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(shown, F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
