"""Toxicity of texts, read through a noisy channel.

Writers hide words by signs for letters, by spacing and by repetition, also all at once. Each suspicious word, and each row of
single letters and signs with gaps between them, becomes one lattice of the characters it may stand for, however long it is,
and a Viterbi search picks the most likely spelling under a character language model. The restored text is then scored.

1. The language model counts the triples of characters of all documents (64 symbols, so at most 64 ** 3 counts).
2. A lexicon of word beginnings and whole words is learnt from labelled rows: those far more frequent in toxic texts.
   A word counts with the log-ratio of its most telling entry.
3. A logistic curve on the sum of these weights and the length of the text gives the score.

Labels are read for at most about `fit_rows` rows, picked by a hash of the id. Null and empty texts have no words and get
the score of a text without findings; without labelled rows every score is 0. Rows that repeat a text get the same score; of
labels that repeat an id, the higher counts. Of equally likely spellings the one found first is taken. `scored` sets the column
`score` and leaves all others as they are.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import labelled_sample, travels, utf8
from waymark.materialize import Written

travels(__name__)

SYMBOLS = 64
#: What a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e", "£": "l"}
SIGNS = "".join(re.escape(c) for c in STANDS_FOR)
LETTER = r"[^\W\d_]"
SEPARATOR = r"[ \t\r\n.\-_*]"
#: Three or more single letters or signs with gaps between them.
SPACED = re.compile(rf"(?<!\w)(?:{LETTER}|[{SIGNS}])(?:{SEPARATOR}++(?:{LETTER}|[{SIGNS}])(?!\w)){{2,}}")
GAP = re.compile(rf"{SEPARATOR}+")
#: A word with a sign between letters, one or two signs at an end that are no punctuation, letters between dots, or a letter twice.
INSIDE = re.compile(rf"{LETTER}[{SIGNS}]+{LETTER}|^[@$0-9]{{1,2}}{LETTER}|{LETTER}[@$0-9]{{1,2}}$|{LETTER}[.\-_*]{LETTER}[.\-_*]{LETTER}|({LETTER})\1")
EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
PIECE = re.compile(rf"{LETTER}+")


@dataclass(frozen=True)
class ToxicRules:
    #: About as many labelled rows are read to fit; all documents go into the language model.
    fit_rows: int = 8_000
    #: Lengths of word beginnings that may enter the lexicon.
    beginnings: tuple[int, int] = (3, 8)
    #: Least share of toxic fit rows (and least number) that have an entry, its least log-ratio and log-likelihood ratio.
    share: float = 0.01
    rows: int = 3
    ratio: float = 1.5
    telling: float = 12.0
    threshold: float = 0.3
    cache: int = 400_000


def _symbol_table() -> np.ndarray:
    t = np.zeros(256, np.int32)
    for c in range(26):
        t[97 + c] = t[65 + c] = 1 + c
    t[128:] = 27 + np.arange(128) % 37
    return t


TABLE = _symbol_table()


def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS ** 3, np.int64)
    for batch in batches:
        for text in utf8(batch.column(0)):
            if text:
                s = TABLE[np.frombuffer(b"  " + text + b" ", np.uint8)]
                np.add.at(total, (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], 1)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["triple", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) as an array over (a, b, c)."""
    rows = docs.select("text").mapInArrow(count_triples, "triple bigint, n bigint").groupBy("triple").agg(F.sum("n").alias("n")).collect()
    n = np.full(SYMBOLS ** 3, 0.1)
    for r in rows:
        n[r["triple"]] += r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(n / n.sum(axis=2, keepdims=True)).astype(np.float32)


class Channel:
    """Restores words under a character language model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    @staticmethod
    def readings(c: str, run: int, apart: bool) -> list[tuple[str, float]]:
        """What a character may stand for, with the cost of the channel; `run` equal ones end with it, `apart` if gaps lie between them."""
        again = [("", 0.5 if run > 2 else 4.0)] if run > 1 else []
        if c in STANDS_FOR:
            return [(x, 1.0) for x in STANDS_FOR[c]] + [(" ", 7.0)] + again
        if not c.isalpha():
            return [("", 0.5), (" ", 4.0)]
        return [(c, 0.0 if apart or run == 1 else 0.6 * run)] + again

    def decode(self, word: str) -> str:
        """The most likely spelling of `word`, in one pass with back-pointers. Where only one state is left, all before it is settled."""
        done: list[str] = []
        scores: dict[tuple[int, int], float] = {(0, 0): 0.0}
        #: For each character since then: its readings, and for each state the index of the one before and of the reading.
        steps: list[tuple[list[tuple[str, float]], array]] = []

        def settled(at: int) -> str:
            out = []
            for readings, back in reversed(steps):
                at, reading = back[2 * at], back[2 * at + 1]
                out.append(readings[reading][0])
            return "".join(reversed(out))

        last, run, gap = "", 0, False
        for c in word:
            if c in STANDS_FOR or c.isalpha():
                run = run + 1 if c == last else 1
                readings = self.readings(c, run, gap)
                last, gap = c, False
            else:
                readings = self.readings(c, 0, False)
                gap = True
            after: dict[tuple[int, int], tuple[float, int, int]] = {}
            for which, (reading, cost) in enumerate(readings):
                codes = [int(TABLE[x]) for x in reading.encode()]
                for origin, ((a, b), score) in enumerate(scores.items()):
                    total = score - cost
                    for code in codes:
                        total += self.model[a][b][code]
                        a, b = b, code
                    if (a, b) not in after or total > after[a, b][0]:
                        after[a, b] = (total, origin, which)
            steps.append((readings, array("H", [x for _, origin, which in after.values() for x in (origin, which)])))
            scores = {state: total for state, (total, _, _) in after.items()}
            if len(scores) == 1:
                done.append(settled(0))
                steps.clear()
        ends = [score + self.model[a][b][0] for (a, b), score in scores.items()]
        done.append(settled(ends.index(max(ends))))
        return "".join(done)

    def pieces(self, word: str) -> list[str]:
        """The restored words in one lower-cased word of a text."""
        if word.isalpha():
            core = word
        else:
            core = EDGE.sub("", word)
            if len(core) == 0:
                return []
        if not INSIDE.search(core):
            return [core] if core.isalpha() else PIECE.findall(core)
        return PIECE.findall(self.decode(core))

    def spaced(self, text: str) -> list[str]:
        """Words written letter by letter, in letters or signs, with gaps of any length between them."""
        found = (GAP.sub(" ", m[0].rstrip("!|(+")) for m in SPACED.finditer(text))
        return [piece for row in found if PIECE.search(row) for piece in PIECE.findall(self.decode(row))]


def entries(word: str, beginnings: tuple[int, int]) -> list[str]:
    """The lexicon entries a word may match: its beginnings, and itself with an end mark."""
    return [word[:k] for k in range(beginnings[0], min(beginnings[1], len(word)) + 1)] + [word + "$"]


def _counts(batches, channel: Channel, rules: ToxicRules, wanted: set[str] | None) -> Iterator[pa.RecordBatch]:
    times, rows, words = Counter(), Counter(), 0
    known: dict[str, list[str]] = {}
    for batch in batches:
        for value in utf8(batch.column(0)):
            text = (value or b"").decode(errors="replace").lower()
            own, pieces = Counter(), Counter()
            if len(known) > rules.cache:
                known.clear()
            for word, n in Counter(text.split()).items():
                if word not in known:
                    known[word] = channel.pieces(word)
                for piece in known[word]:
                    pieces[piece] += n
            pieces.update(channel.spaced(text))
            for piece, n in pieces.items():
                words += n
                for e in entries(piece, rules.beginnings):
                    if wanted is None or e in wanted:
                        own[e] += n
            times.update(own)
            rows.update(own.keys())
    keys = list(times)
    yield pa.RecordBatch.from_arrays([
        pa.array([*keys, ""]), pa.array([*(times[k] for k in keys), words], pa.int64()), pa.array([*(rows[k] for k in keys), 0], pa.int64())],
        ["entry", "times", "rows"])


def _totals(texts: DataFrame, channel: Channel, rules: ToxicRules, wanted: set[str] | None) -> DataFrame:
    return (
        texts.select("text").mapInArrow(lambda b: _counts(b, channel, rules, wanted), "entry string, times bigint, rows bigint")
        .groupBy("entry").agg(F.sum("times").alias("times"), F.sum("rows").alias("rows"))
    )


def lexicon(sample: DataFrame, channel: Channel, rules: ToxicRules) -> dict[str, tuple[float, float]]:
    """Entry -> (log-ratio, how telling it is), of rows (text, label)."""
    toxic, clean = sample.filter("label = 1"), sample.filter("label = 0")
    least = max(rules.rows, math.ceil(rules.share * toxic.count()))
    found = {r["entry"]: r["times"] for r in _totals(toxic, channel, rules, None).filter((F.col("rows") >= least) | (F.col("entry") == "")).collect()}
    other = {r["entry"]: r["times"] for r in _totals(clean, channel, rules, set(found) - {""}).collect()}
    n_toxic, n_clean = found.pop("", 0) + 1, other.pop("", 0) + 1
    out = {}
    for e, a in found.items():
        b = other.get(e, 0)
        ratio = math.log((a + 1) / n_toxic) - math.log((b + 1) / n_clean)
        if ratio >= rules.ratio:
            both = (a + b) / (n_toxic + n_clean)
            telling = a * math.log(a / n_toxic / both) + (b * math.log(b / n_clean / both) if b else 0.0)
            if telling >= rules.telling:
                out[e] = (ratio, telling)
    return out


class Scorer:
    """Weight of a text: the sum over its restored words."""

    def __init__(self, channel: Channel, entries_: dict[str, tuple[float, float]], rules: ToxicRules):
        self.channel, self.entries, self.rules, self.known = channel, entries_, rules, {}

    def piece(self, piece: str) -> float:
        hits = [self.entries[e] for e in entries(piece, self.rules.beginnings) if e in self.entries]
        return max(hits, key=lambda h: h[1])[0] if hits else 0.0

    def weigh(self, value: bytes | None) -> tuple[float, int]:
        text = (value or b"").decode(errors="replace").lower()
        words, known = text.split(), self.known
        if len(known) > self.rules.cache:
            known.clear()
        for word in set(words).difference(known):
            known[word] = sum(map(self.piece, self.channel.pieces(word)))
        return sum(map(known.__getitem__, words)) + sum(map(self.piece, self.channel.spaced(text))), len(words)


def curve_inputs(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    w, n = np.log1p(weight), np.log1p(words)
    return np.stack([np.ones_like(w), w, n, w * n, np.sqrt(weight / (words + 10.0)), weight > 0], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - y) + ridge * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), gradient)
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class ToxicModel:
    model: np.ndarray
    entries: dict[str, tuple[float, float]]
    beta: np.ndarray | None
    rules: ToxicRules

    def score_udf(self):
        model, entries_, beta, rules = self.model, self.entries, self.beta, self.rules

        @F.arrow_udf("double")
        def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scorer = Scorer(Channel(model), entries_, rules)
            for column in columns:
                if beta is None:
                    yield pa.array(np.zeros(len(column)))
                    continue
                weights = np.array([scorer.weigh(v) for v in utf8(column)], float).reshape(-1, 2)
                z = curve_inputs(weights[:, 0], weights[:, 1]) @ beta
                yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _weighed(batches, channel, entries_, rules) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(channel, entries_, rules)
    for batch in batches:
        pairs = np.array([scorer.weigh(v) for v in utf8(batch.column(0))], float).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), batch.column(1).cast(pa.float64())], ["weight", "words", "label"])


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicRules = ToxicRules()) -> ToxicModel:
    """Model of `docs` (doc_id, text) and `labels` (doc_id, label 0 or 1)."""
    sample = Written(labelled_sample(docs, labels, rules.fit_rows)).df
    if sample.isEmpty():
        return ToxicModel(np.zeros((1, 1, 1), np.float32), {}, None, rules)
    model = language_model(docs)
    channel = Channel(model)
    found = lexicon(sample, channel, rules)
    rows = sample.mapInArrow(lambda b: _weighed(b, channel, found, rules), "weight double, words double, label double").toPandas().sort_values(["label", "words", "weight"])
    beta = fit_curve(curve_inputs(rows["weight"].to_numpy(), rows["words"].to_numpy()), rows["label"].to_numpy())
    return ToxicModel(model, found, beta, rules)


def scored(docs: DataFrame, model: ToxicModel, score: str = "score") -> DataFrame:
    """`docs` with the score of each text."""
    return docs.withColumn(score, model.score_udf()("text"))
