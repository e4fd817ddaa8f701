"""Quality rules: a hashed n-gram log-likelihood ratio, next to plain counts.

Words and word pairs of every text are hashed into buckets. Two multinomials over the buckets are
estimated with add-one smoothing: the target from the trusted documents (labelled good and not toxic), the raw one from
all documents. The raw counts are first scaled to the target's total, so that smoothing weighs alike on both and an unseen
bucket has ratio 0 at every size of the corpus. A text's ratio is the mean of log(target / raw) over its n-grams, so it
does not depend on length. A text is kept if its ratio reaches the threshold; no document is drawn by chance.

The number of buckets follows the corpus: a power of two, one bucket at least for ``BYTES_A_BUCKET`` bytes of text. With a
fixed number, good and bad n-grams come to share buckets as the corpus grows, and all ratios drift to 0. The buckets are
dealt into ranges, the slices. One path serves every size:

1. Ids meet labels (texts stay where they are); a note of every input partition says which of its rows are trusted.
2. Each partition's texts are cut into chunks of some ``CHUNK`` n-grams. A task counts the different buckets of a chunk and
   sends one packed row per slice. Where a slice's rows meet, their counts are added up, and every row is answered with the sums
   of the buckets that it had. The answers of a chunk become a file in the shared folder; the driver gets two totals.
3. A task that judges texts cuts them into the same chunks and reads the answers of each.

So all that is sent or read grows with the texts, and a task holds a chunk or a slice. Notes and answers belong to the partitions
that the input's plan has. An input that reads no files is written to the shared folder first; one that does and shuffles or samples
what it reads may deal its rows anew when it is read again: the ids of every row and the buckets of every answer are compared,
and such an input is refused with an error, not judged by others' counts.

Null and empty texts have no words, fail the base rules and are not kept. A text without n-grams has ratio 0. If nothing is
trusted, the target is uniform like the smoothing, and every text's ratio is set to 0, so that only base rules decide.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import WordHashes, gram_hashes, mix, stored, text_bytes, unwrapped, work_path, wrapped
from chainage.llm.warc_chunks import _uri

LEAST_BITS = 20
BYTES_A_BUCKET = 64
#: Slices are this many, or as many as hold the most buckets each.
LEAST_SLICES, MOST_BUCKETS = 512, 1 << 18
CHUNK = 1 << 21
SALTS = 8
THRESHOLD = -0.25
SYMBOLS = b"#*$%&|<>"
REPEAT = 5
_SPACE = [32, *range(9, 14)]


def base_counts(text: bytes, hashes: np.ndarray) -> tuple[int, int, int, int]:
    """Code points in words, symbols, repeated lines, and words in repeated windows."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(seen.sum() - seen[128:192].sum() - seen[_SPACE].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    windows = gram_hashes(hashes, REPEAT)
    if len(windows):
        _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[which] > 1)
        if len(again):
            covered = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(covered, again, 1)
            np.add.at(covered, again + REPEAT, -1)
            repeated = int((covered.cumsum() > 0).sum())
    return chars, int(seen[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated


def buckets_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The buckets of a text's words and word pairs."""
    both = np.concatenate([mix(hashes), gram_hashes(hashes, 2)])
    return (both >> np.uint64(64 - bits)).astype(np.int64)


def bits_for(size: int) -> int:
    """Two to this power buckets are used for so many bytes of text."""
    return max(LEAST_BITS, (-(-size // BYTES_A_BUCKET) - 1).bit_length())


def slices_for(bits: int) -> int:
    return max(LEAST_SLICES, (1 << bits) // MOST_BUCKETS)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, so that the zeros of small ones lie together and compress."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T), 1)


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"), *more)


def _write(fs: pafs.FileSystem, path: str, table: pa.Table) -> None:
    """Tasks tried again write the same rows; a file has its name only when it is whole."""
    own = f"{path}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out, pa.ipc.new_stream(out, table.schema) as to:
        to.write_table(table)
    fs.move(own, path)


def _read(folder: str, name: str) -> pa.Table | None:
    fs, at = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{at}/{name}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{at}/{name}", compression=None) as source, pa.ipc.open_stream(source) as stream:
        return stream.read_all()


def _files_by(batches, names: list[str], folder: str, rest: list[str]):
    """Writes a file for every run of rows that agree in ``names``; yields the rows of each file."""
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    now, held = None, []

    def done():
        table = pa.Table.from_batches(held)
        _write(fs, f"{at}/{'-'.join(map(str, now))}", table.select(rest))
        return table

    for batch in batches:
        keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and keys[a] != now:
                yield done()
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


@dataclass(frozen=True)
class Ratios:
    """What tasks need to judge texts: notes and answers by partition, and the scale of raw counts; no answers if all ratios are 0."""

    notes: str
    answers: str | None
    bits: int
    slices: int
    chunk: int
    scale: float = 0.0

    @property
    def wide(self) -> int:
        return (1 << self.bits) // self.slices


class Partition:
    """A task's place in the notes and answers of its partition."""

    def __init__(self, ratios: Ratios):
        self.ratios, self.part = ratios, TaskContext.get().partitionId()
        self.notes, self.row, self.chunk = None, 0, 0

    def trusted(self, ids: pa.Array) -> list[bool]:
        """For the next rows of the partition, after their ids were compared."""
        if not len(ids):
            return []
        if self.notes is None:
            self.notes = _read(self.ratios.notes, str(self.part))
        found = self.notes.slice(self.row, len(ids)) if self.notes is not None else None
        self.row += len(ids)
        if found is None or found["doc_id"].combine_chunks() != ids:
            raise RuntimeError("the input dealt its rows anew; write it to a table first")
        return found["good"].to_pylist()

    def pieces(self, met: np.ndarray):
        """Slice, and where it begins and ends in the sorted buckets."""
        cuts = np.searchsorted(met, np.arange(self.ratios.slices + 1) * self.ratios.wide)
        for i in np.flatnonzero(np.diff(cuts)):
            yield int(i), int(cuts[i]), int(cuts[i + 1])

    def of(self, buckets: np.ndarray) -> np.ndarray:
        """The ratios of all n-grams of the next chunk."""
        name, self.chunk = f"{self.part}-{self.chunk}", self.chunk + 1
        if self.ratios.answers is None or not len(buckets):
            return np.zeros(len(buckets))
        met, which = np.unique(buckets, return_inverse=True)
        answers = _read(self.ratios.answers, name)
        rows = {r["slice"]: r for r in answers.to_pylist()} if answers is not None else {}
        out = np.empty(len(met))
        for i, a, b in self.pieces(met):
            row = rows.get(i)
            if row is None or row["crc"] != zlib.crc32(met[a:b].tobytes()):
                raise RuntimeError("the input dealt its rows anew; write it to a table first")
            target, raw = unplaned(row["target"]), unplaned(row["raw"])
            out[a:b] = np.log((target + 1) / (raw * self.ratios.scale + 1)).astype("<f4")
        return out[which]


def _noted(docs: DataFrame, labels: DataFrame, folder: str) -> int:
    """Writes a note of every partition: its rows' ids in order and whether they are trusted. Gives the bytes of text."""
    trusted = (
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("trusted_id"))
        .agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
        .filter("good")
        .select("trusted_id", F.explode(F.lit(list(range(SALTS)))).alias("trusted_salt"))
    )
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.octet_length(text_bytes()).cast("bigint").alias("n_bytes"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("at"),
    ).withColumn("salt", F.pmod("at", F.lit(SALTS)).cast("int"))
    met = (F.col("doc_id") == F.col("trusted_id")) & (F.col("salt") == F.col("trusted_salt"))
    # Labels grow with the corpus: the plan is the same for every size, not a broadcast that ends one day.
    joined = rows.join(trusted.hint("merge"), met, "left").select(
        "part", "at", "doc_id", F.col("trusted_id").isNotNull().alias("good"), "n_bytes"
    )

    def written(batches):
        for table in _files_by(batches, ["part"], folder, ["doc_id", "good"]):
            total = pa.compute.sum(table["n_bytes"]).as_py()
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n_bytes"])

    ordered = joined.repartition("part").sortWithinPartitions("part", "at")
    return ordered.mapInArrow(written, "n_bytes bigint").agg(F.sum("n_bytes")).first()[0] or 0


_ASKED = "slice bigint, part int, chunk int, gaps binary, target binary, raw binary"
_ANSWERED = "part int, chunk int, slice bigint, crc bigint, target binary, raw binary, n_target bigint, n_raw bigint"


def _asked(ratios: Ratios) -> Callable:
    """Per chunk of texts and slice: the different buckets and how often they occur, in trusted and in all texts."""

    def asked(batches):
        hashes, partition = WordHashes(9), Partition(ratios)
        buckets, good, size = [], [], 0

        def packed():
            every = np.concatenate(buckets) if buckets else np.empty(0, np.int64)
            met, which, raw = np.unique(every, return_inverse=True, return_counts=True)
            weights = np.repeat(np.array(good, float), [len(b) for b in buckets])
            target = np.bincount(which, weights, len(met)).astype(np.int64)
            rows = [
                (i, partition.part, partition.chunk, planes(np.diff(met[a:b], prepend=i * ratios.wide)), planes(target[a:b]), planes(raw[a:b]))
                for i, a, b in partition.pieces(met)
            ]
            partition.chunk += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slice", "part", "chunk", "gaps", "target", "raw"]
            )

        for batch in batches:
            trusted = partition.trusted(batch.column(0))
            for is_good, text in zip(trusted, batch.column(1).to_pylist(), strict=True):
                buckets.append(buckets_of(hashes.of(text.split()), ratios.bits))
                good.append(is_good)
                size += len(buckets[-1])
                if size >= ratios.chunk:
                    yield packed()
                    buckets, good, size = [], [], 0
        if buckets:
            yield packed()

    return asked


def _answered(wide: int) -> Callable:
    """For rows sorted by slice: a row of totals per slice (its part is -1), and an answer to each row."""

    def answered(batches):
        now, held = None, []

        def done():
            total = np.zeros((2, wide), np.int64)
            for _, _, gaps, target, raw in held:
                at = unplaned(gaps).cumsum()
                total[0, at] += unplaned(target)
                total[1, at] += unplaned(raw)
            yield -1, now, now, 0, b"", b"", int(total[0].sum()), int(total[1].sum())
            for part, chunk, gaps, _, _ in held:
                at = unplaned(gaps).cumsum()
                crc = zlib.crc32((at + now * wide).tobytes())
                yield part, chunk, now, crc, planes(total[0, at]), planes(total[1, at]), 0, 0

        def batched():
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            names = ["part", "chunk", "slice", "crc", "target", "raw", "n_target", "n_raw"]
            columns = zip(*done(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for i, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i != now:
                    if held:
                        yield batched()
                    now, held = i, []
                held.append(row)
        if held:
            yield batched()

    return answered


def settled(docs: DataFrame) -> DataFrame:
    """The input itself if it reads files, else a written copy."""
    return docs if docs.inputFiles() else stored(docs, "llr-input")


def log_ratios(docs: DataFrame, labels: DataFrame) -> Ratios:
    """Learns log(target / raw) of all buckets and files, for every chunk of texts, those that it holds."""
    notes, answers = (_uri(work_path(docs.sparkSession, f"llr-{name}")) for name in ("notes", "answers"))
    bits = bits_for(_noted(docs, labels, notes))
    learning = Ratios(notes, None, bits, slices_for(bits), CHUNK)

    def filed(batches):
        totals = [0, 0]

        def answers_only():
            for batch in batches:
                for k, name in enumerate(("n_target", "n_raw")):
                    totals[k] += pa.compute.sum(batch.column(name)).as_py() or 0
                yield batch.filter(pa.compute.greater_equal(batch.column("part"), 0))

        for _ in _files_by(answers_only(), ["part", "chunk"], answers, ["slice", "crc", "target", "raw"]):
            pass
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()) for t in totals], ["n_target", "n_raw"])

    asked = _rows(docs).mapInArrow(_asked(learning), _ASKED)
    answered = (
        asked.repartition("slice").sortWithinPartitions("slice").mapInArrow(_answered(learning.wide), _ANSWERED)
    )
    totals = (
        answered.repartition("part", "chunk")
        .sortWithinPartitions("part", "chunk", "slice")
        .mapInArrow(filed, "n_target bigint, n_raw bigint")
        .agg(F.sum("n_target"), F.sum("n_raw"))
        .first()
    )
    if not totals[0]:
        return learning
    return replace(learning, answers=answers, scale=totals[0] / totals[1])


def verdicts(batches, ratios: Ratios, threshold: float):
    """Slices of batches whose first columns are id and text, with ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, ratio, kept`` of each text."""
    hashes, partition = WordHashes(9), Partition(ratios)
    pending, counts, buckets, size = [], [], [], 0

    def judged():
        found = partition.of(np.concatenate(buckets))
        ends = np.cumsum([len(b) for b in buckets])
        out = []
        for (n_words, base), own in zip(counts, np.split(found, ends[:-1]), strict=True):
            ratio = float(own.mean()) if n_words else 0.0
            failed = n_words < 10 or 100 * base[3] > 20 * n_words
            out.append((n_words, *base, failed, ratio, not failed and ratio >= threshold))
        at = 0
        for part in pending:
            yield part, out[at : at + part.num_rows]
            at += part.num_rows

    for batch in batches:
        partition.trusted(batch.column(0))
        start = 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            words = text.split()
            h = hashes.of(words)
            counts.append((len(words), base_counts(text, h) if text else (0, 0, 0, 0)))
            buckets.append(buckets_of(h, ratios.bits))
            size += len(buckets[-1])
            if size >= ratios.chunk:
                pending.append(batch.slice(start, i + 1 - start))
                yield from judged()
                start, pending, counts, buckets, size = i + 1, [], [], [], 0
        if start < batch.num_rows:
            pending.append(batch.slice(start))
    if counts:
        yield from judged()


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``ratio`` and ``kept`` of every row."""
    docs = settled(docs)
    ratios = log_ratios(docs, labels)
    kinds = {
        "doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(),
        "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "ratio": pa.float64(),
        "kept": pa.bool_(),
    }

    def judged(batches):
        for part, found in verdicts(batches, ratios, threshold):
            columns = list(zip(*found, strict=True)) or [()] * 8
            arrays = [pa.array(c, t) for c, t in zip(columns, list(kinds.values())[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], list(kinds))

    return _rows(docs).mapInArrow(
        judged,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
        " n_repeat_words bigint, base_failed boolean, ratio double, kept boolean",
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The kept rows with all their columns; a map that drops rows where they lie."""
    docs = settled(docs)
    ratios = log_ratios(docs, labels)
    rows = wrapped(docs, F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")).select("doc_id", "text", "row")

    def chosen(batches):
        for part, found in verdicts(batches, ratios, threshold):
            kept = pa.array([v[-1] for v in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(2)], ["row"]).filter(kept)

    kind = rows.schema["row"].dataType.simpleString()
    return unwrapped(rows.mapInArrow(chosen, f"row {kind}"), docs.columns)
