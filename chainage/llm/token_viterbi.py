"""Token counts by a count-only Viterbi search.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at each character of a text; for each
character only the best score of a segmentation that ends there and its number of pieces are kept, so no
tokens are built. Ties go to the piece that begins first, as in the unigram model of the ``tokenizers`` library: a later
start must be strictly better. A character that no piece of one character covers may stand alone at the lowest score
less 10 and counts as its UTF-8 bytes where the vocabulary has byte pieces, else a run of them counts once.

The vocabulary is a file: a ``.model`` of ``sentencepiece``, whose pieces and scores are taken as they are. Blanks become
``▁`` and a text that isn't empty gets one in front.

If the scores are whole numbers (sums are then exact in any order) and no piece reaches over the start of a run of
``▁`` or over a line break, the search is exact on each stretch between those places, and the results of short stretches are
remembered, in bounded memory. Else the text is searched as one stretch. Texts are mapped where they lie; nothing
is shuffled. Null and empty texts have no tokens and score 0.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNKNOWN_COST = 10.0


def pieces_of(model_file: str) -> list[tuple[str, float]]:
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the tokens of texts under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], most: int = 300_000):
        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in pieces:
            scores[piece] = score
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores.values()) - UNKNOWN_COST
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.single = {p for p in scores if len(p) == 1}
        over = any(re.search(f"[^{BLANK}]{BLANK}|.\n|\n.", p, re.S) for p in scores)
        self.cut = not over and all(float(s).is_integer() for s in scores.values()) and self.bytes
        self.stretches = re.compile(f"\n+|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
        self.known: dict[str, tuple[float, int]] = {}
        self.most = most

    def search(self, text: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation."""
        n = len(text)
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        unknown_end = [False] * (n + 1)
        # Matches come by their end, the longest (the one that begins first) before others.
        matches = self.automaton.iter(text)
        end, found = next(matches, (n, None))
        for i in range(n):
            best = None
            while end == i:
                length, own = found
                begin = i + 1 - length
                value = score[begin] + own
                if best is None or value > best:
                    best, pieces = value, count[begin] + 1
                end, found = next(matches, (n, None))
            alone = text[i] not in self.single
            unknown = False
            if alone and (best is None or score[i] + self.unknown > best):
                best, unknown = score[i] + self.unknown, True
                if self.bytes:
                    pieces = count[i] + len(text[i].encode())
                else:
                    pieces = count[i] + (not unknown_end[i])
            score[i + 1], count[i + 1], unknown_end[i + 1] = best, pieces, unknown
        return score[n], count[n]

    def _remembered(self, stretch: str) -> tuple[float, int]:
        found = self.known.get(stretch)
        if found is None:
            found = self.search(stretch)
            if len(stretch) <= 48:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[stretch] = found
        return found

    def count(self, text: str) -> tuple[int, float]:
        """Number of tokens, and their score."""
        if not text:
            return 0, 0.0
        text = BLANK + text.replace(" ", BLANK)
        if not self.cut:
            score, n = self.search(text)
            return n, score
        get, slow = self.known.get, self._remembered
        n, score = 0, 0.0
        for stretch in self.stretches.findall(text):
            s, c = get(stretch) or slow(stretch)
            n += c
            score += s
        return n, score


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, score``; the file must lie at this path wherever tasks run, as libraries do."""

    def counted(batches):
        counter = Counter(pieces_of(model_file))
        for batch in batches:
            found = [counter.count(t) for t in batch.column(1).to_pylist()]
            n, score = np.array(found, float).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(score)], ["doc_id", "n_tokens", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(counted, "doc_id bigint, n_tokens bigint, score double")
