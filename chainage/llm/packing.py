"""Best-fit packing with swap-based local search.

Documents become token ids (then id 1) and are cut into pieces of at most ``capacity`` tokens. Pieces are dealt by
hash into groups of bounded size, and each group is packed in a task of its own: best fit in decreasing order
first, then local search among bins that aren't full. It takes the emptiest bin and moves its pieces into others'
gaps, or exchanges one or two pieces against one so that the other bin gets fuller. Each step increases the sum of
squared fills, so the search ends; a bin that becomes empty is dropped. It stops early at the fewest bins that the
sum of lengths allows. Groups are independent, so at most about one bin for each group is lost to the split.

The tokenizer's ids of a text are those of its words: its normaliser and word splitter never look across ASCII
white space. So ids of short words are remembered, in bounded memory. Null and empty texts are the
id 1 alone. Rows that repeat a ``doc_id`` are packed as rows of their own.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chainage.llm.common import stored, text_bytes

CAPACITY, END = 4096, 1
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


#: Words of ASCII and letters of two Latin blocks: their lower case is the same everywhere, nothing in them composes.
_LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f"
_SIGNS = "!-&(-/:-@\\[-`{-~"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
#: Between a letter or digit and an ASCII sign, but for the apostrophe of contractions.
_BORDER = re.compile(f"(?<=[a-z0-9{_LETTERS}])(?=[{_SIGNS}])|(?<=[{_SIGNS}])(?=[a-z0-9{_LETTERS}])")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unseen = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(unseen)}


class _Remembered(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    Plain words are cut where the tokenizer's word splitter cuts them in any case, between letters or digits and ASCII
    signs. A part of letters only goes to the tokenizer's model at once, any other through all its steps.
    """

    def __init__(self, tokenizer_file: str, most: int = 300_000):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.parts = _Remembered(self._part, most)
        self.words = _Remembered(self._word, most)

    def _part(self, part: str) -> bytes:
        if not part.isalpha():
            return self._whole(part)
        if not part.isascii():
            part = "".join(map(self.letters.__getitem__, part.encode()))
        return np.array([t.id for t in self.tokenize(part)], "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        # What may hold a special token only matches as it stands.
        if "<|" in text or not _PLAIN.fullmatch(text):
            return self._whole(text)
        return b"".join(map(self.parts.__getitem__, _BORDER.split(text.lower())))

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


def cut(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document."""

    def pieces(batches):
        encoder = Encoder(tokenizer_file)
        end = END.to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encoder.ids(text) + end
                for piece, begin in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[begin : begin + 4 * capacity]
                    out.append((doc_id, piece, begin // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(pieces, PIECES)


# -- packing of one group --------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers, by best fit in decreasing order."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by what is left in them
    left_over, bins = 0, []  # bit g of left_over: some bin has g left
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = left_over >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = open_bins[gap].pop()
            if not open_bins[gap]:
                left_over &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if gap > n:
            open_bins[gap - n].append(b)
            left_over |= 1 << (gap - n)
    return bins


def _exchange(mine: list[int], theirs: list[int], gap: int, lengths: list[int]):
    """The change of the other bin that fills its gap best: what it takes, what it gives, and the gain."""
    best = ((), (), 0)
    for x, i in enumerate(mine):
        n = lengths[i]
        if n <= gap and n > best[2]:  # move
            best = ((i,), (), n)
        for j in theirs:  # one for one
            gain = n - lengths[j]
            if best[2] < gain <= gap:
                best = ((i,), (j,), gain)
        for k in mine[x + 1 :]:  # two for one
            for j in theirs:
                gain = n + lengths[k] - lengths[j]
                if best[2] < gain <= gap:
                    best = ((i, k), (j,), gain)
        for y, j in enumerate(theirs):  # one for two
            for k in theirs[y + 1 :]:
                gain = n - lengths[j] - lengths[k]
                if best[2] < gain <= gap:
                    best = ((i,), (j, k), gain)
        if best[2] == gap:
            break
    return best


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empties the emptiest bins into the gaps of others, as long as that increases the sum of squared fills."""
    fewest = -(-sum(lengths) // capacity)
    fill = [sum(lengths[i] for i in b) for b in bins]
    alive = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: (fill[b], b))
    full = [bins[b] for b in range(len(bins)) if fill[b] >= capacity]
    stuck: list[int] = []
    while alive and len(full) + len(stuck) + len(alive) > fewest:
        source = alive.pop(0)
        changed = True
        while changed and bins[source]:
            changed = False
            for other in reversed(alive):  # the fullest first
                if not bins[source]:
                    break
                if fill[other] < fill[source] or fill[other] == capacity:
                    continue
                take, give, gain = _exchange(bins[source], bins[other], capacity - fill[other], lengths)
                if not gain:
                    continue
                bins[source] = [i for i in bins[source] if i not in take] + list(give)
                bins[other] = [i for i in bins[other] if i not in give] + list(take)
                fill[source] -= gain
                fill[other] += gain
                changed = True
        if bins[source]:
            stuck.append(source)
        alive.sort(key=lambda b: (fill[b], b))
    return full + [bins[b] for b in stuck + alive if bins[b]]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def packed(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = 30_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces. A group holds about ``group_pieces`` of them."""
    total = pieces.count()
    groups = max(1, -(-total // group_pieces))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = rows["length"].to_pylist()
        first = rows["group"][0].as_py() << 32
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for s, bin_ in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in bin_:
                sequence[i], offset[i] = first + s, at
                at += lengths[i]
        return rows.drop(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("group")
    return pieces.select("*", group).groupBy("group").applyInArrow(pack, PACKED)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    return packed(stored(cut(docs, tokenizer_file, capacity), "pieces"), capacity)
