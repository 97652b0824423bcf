"""Token counts under a unigram vocabulary, without making the tokens.

A Viterbi search picks the segmentation with the largest sum of piece scores. Only two numbers are carried for each
position: the best sum, and the number of pieces on that path. An Aho-Corasick automaton enumerates the pieces that end at
each position.

Ties are those of the common unigram tokenizers: of equal sums the path whose last piece starts first stays, and an
unknown character scores 10 below the lowest piece and is tried only where no piece is that single character. Unknown
characters in a row are one piece, or as many as they have UTF-8 bytes where the vocabulary has all byte pieces.

Blanks are written as the blank mark, and one stands before the text. As no piece has the mark after another character, the
search falls apart at the marks, and equal parts are counted once. That is exact where all scores are whole numbers;
otherwise, or where some piece does cross a mark, whole texts are searched.

Null and empty texts have no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import travels

travels(__name__)

MARK = "▁"
UNKNOWN_BELOW = 10.0
PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and scores; `bytes_known` tells whether all byte pieces are there."""

    pieces: tuple[tuple[str, float], ...]

    @property
    def bytes_known(self) -> bool:
        return {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in self.pieces}

    @property
    def parts_alone(self) -> bool:
        """Whether texts can be cut at the marks."""
        whole = all(float(s).is_integer() for _, s in self.pieces)
        return whole and (self.bytes_known or any(p == MARK for p, _ in self.pieces)) and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in self.pieces)


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file; the driver reads it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary(tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())))


class Counter:
    def __init__(self, vocabulary: Vocabulary, cache: int = 500_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_BELOW
        self.as_bytes, self.alone = vocabulary.bytes_known, vocabulary.parts_alone
        self.known: dict[str, int] = {}
        self.cache = cache

    def search(self, text: str) -> int:
        """Pieces on the best path through `text`."""
        best: list[float] = [0.0]
        count, unknown = [0], [False]
        matches: list[tuple[int, float]] = []
        found = self.automaton.iter(text)
        following = next(found, None)
        for end, c in enumerate(text, 1):
            matches.clear()
            while following is not None and following[0] == end - 1:
                matches.append(following[1])
                following = next(found, None)
            at, top = -1, 0.0
            for length, score in matches:
                total = score + best[end - length]
                if at < 0 or total > top or total == top and end - length < at:
                    at, top = end - length, total
            lost = False
            if c not in self.singles:
                total = self.unknown + best[end - 1]
                if at < 0 or total > top:
                    at, top, lost = end - 1, total, True
            best.append(top)
            unknown.append(lost)
            if not lost:
                count.append(count[at] + 1)
            elif self.as_bytes:
                count.append(count[at] + len(c.encode(errors="replace")))
            else:
                count.append(count[at] + (not unknown[at]))
        return count[-1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.alone:
            return self.search(text)
        known, parts = self.known, PART.findall(text)
        if len(known) > self.cache:
            known.clear()
        for part in set(parts).difference(known):
            known[part] = self.search(part)
        return sum(map(known.__getitem__, parts))


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    @F.arrow_udf("bigint")
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(vocabulary)
        for column in columns:
            yield pa.array(np.fromiter((counter.count(v.as_py()) for v in column), np.int64, len(column)))

    return docs.select("doc_id", count("text").alias("n_tokens"))
