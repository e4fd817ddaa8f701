"""What the operators of this subpackage share: tables, words, hashes and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything but ASCII letters, digits and bytes of non-ASCII characters becomes a blank.
_KEPT = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(128, 256))
ALNUM = bytes(c if c in _KEPT else 32 for c in range(256))
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names.

    Only a session on one machine (master ``local``) may lack that setting; it
    then gets a temporary folder. A cluster without a shared folder is refused.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back; this cuts the lineage."""
    path = work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text") -> Column:
    """The text in UTF-8; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("binary"), F.lit(b"").cast("binary"))


def crc_of(column: str) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary"))


def row_key(*columns: str) -> Column:
    """One fixed-length key of some columns, nulls included: rows with equal columns share it."""
    parts = [F.col(f"`{c}`").cast("string") for c in columns]
    sized = [
        F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("null")) for p in parts
    ]
    return F.unhex(F.substring(F.sha2(F.concat_ws("|", *sized).cast("binary"), 256), 1, 32))


def lowered_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lowered; bytes methods know ASCII only."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered."""
    return text.lower().translate(ALNUM).split()


class WordHashes(dict):
    """xxHash64 of words, remembered for words seen lately; the memory is bounded."""

    def __init__(self, seed: int, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(h)


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns in one struct ``row`` (fields c0, c1, ...), so that own names can't meet theirs."""
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(F.struct(*fields).alias("row"), *more)


def unwrapped(rows: DataFrame, names: list[str], **instead: Column) -> DataFrame:
    """The columns of ``row`` again, some of them replaced."""
    return rows.select(
        *[instead.get(name, F.col(f"row.c{i}")).alias(name) for i, name in enumerate(names)]
    )
