"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages, its label belongs to the bag. Every passage is encoded; gated attention, learnt from the
labels of documents, gives each passage a weight, and a linear layer scores the weighted sum of the encodings.

* Encoding: shares of kinds of characters, word lengths, repeated and different words of a passage, and two numbers for the
  words it shares with the passage before. No words are remembered, so it works alike in every language.
* Model: h = tanh(W x); attention softmax(u . (tanh(V h) * sigmoid(U h))); logit = a . sum(attention * h) + b. It is
  trained by Adam on about `fit_rows` labelled rows at most, picked by a hash of the id; the seed is fixed. All passages of
  these rows take part, flat: attention is normalised within each bag, however many passages it has.

Texts are cut into passages of `passage` words, to the end. Null and empty texts are one empty passage and get its score.
Without labelled rows every score is 0. Rows that repeat a text get the same score; of labels that repeat an id, the higher
counts. `scored` sets the column `score` and leaves all others as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import labelled_sample, travels, utf8

travels(__name__)


@dataclass(frozen=True)
class QualityRules:
    #: About as many labelled rows are read to fit, with all their passages.
    fit_rows: int = 8_000
    passage: int = 48
    hidden: int = 24
    gate: int = 12
    steps: int = 500
    batch: int = 256
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11
    threshold: float = 0.3


KINDS = ("lower", "upper", "digit", "blank", "line", "stop", "quote", "bracket", "sign", "bar", "mark", "wide")


def _kind_table() -> np.ndarray:
    t = np.full(256, KINDS.index("sign"), np.int64)
    for name, chars in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("blank", b" \t"),
                        ("line", b"\n\r\v\f"), ("stop", b".,;:"), ("quote", b"\"'`"), ("bracket", b"()[]{}<>"), ("bar", b"|_=-+/\\"), ("mark", b"!?")):
        t[list(chars)] = KINDS.index(name)
    t[128:] = KINDS.index("wide")
    return t


TABLE = _kind_table()
FEATURES = len(KINDS) + 8


def encode(text: bytes, passage: int) -> np.ndarray:
    """One row of numbers for each passage."""
    raw = np.frombuffer(text, np.uint8)
    kind = TABLE[raw]
    space = (kind == 3) | (kind == 4)
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(raw) else np.empty(0, np.int64)
    n = len(starts)
    if n == 0:
        return np.zeros((1, FEATURES))
    words = text.split()
    code = np.fromiter(map(hash, words), np.int64, n)
    size = np.fromiter(map(len, words), np.float64, n)
    firsts = np.arange(0, n, passage)
    m = len(firsts)
    at = np.append(starts[firsts], len(raw))
    at[0] = 0
    counts = np.bincount(np.repeat(np.arange(m), np.diff(at)) * len(KINDS) + kind, minlength=m * len(KINDS)).reshape(m, -1)
    length = np.diff(at).astype(float)
    own = np.diff(np.append(firsts, n)).astype(float)
    of = np.arange(n) // passage
    again = np.concatenate(([0.0], code[1:] == code[:-1]))
    again[firsts] = 0
    order = np.lexsort((code, of))
    new = np.ones(n)
    new[1:] = (code[order][1:] != code[order][:-1]) | (of[order][1:] != of[order][:-1])
    different = np.add.reduceat(new, firsts)
    mean = np.add.reduceat(size, firsts) / own
    spread = np.sqrt(np.maximum(np.add.reduceat(size * size, firsts) / own - mean * mean, 0))
    ends_marked = np.add.reduceat((kind[starts + size.astype(np.int64) - 1] >= KINDS.index("sign")) & (kind[starts + size.astype(np.int64) - 1] != KINDS.index("wide")), firsts, dtype=float)
    before = np.concatenate(([0.0], different[:-1] / own[:-1]))
    return np.column_stack([
        counts / length[:, None], np.log1p(own) / 4, mean / 10, np.minimum(spread, 20) / 10, different / own, np.add.reduceat(again, firsts) / own,
        ends_marked / own, before, np.full(m, min(m, 20) / 20)])


class AttentionModel:
    """The parameters, forward and backward passes. Bags lie flat: one row for each passage, and where each bag starts."""

    NAMES = ("W", "w0", "V", "U", "u", "a", "b")

    def __init__(self, rules: QualityRules, mean: np.ndarray, scale: np.ndarray):
        r = np.random.default_rng(rules.seed)
        d, h, g = FEATURES, rules.hidden, rules.gate
        self.mean, self.scale = mean, scale
        self.p = {"W": r.normal(0, d ** -0.5, (d, h)), "w0": np.zeros(h), "V": r.normal(0, h ** -0.5, (h, g)), "U": r.normal(0, h ** -0.5, (h, g)),
                  "u": r.normal(0, g ** -0.5, g), "a": r.normal(0, h ** -0.5, h), "b": np.zeros(())}

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["w0"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["u"]
        weight = np.exp(e - np.maximum.reduceat(e, first)[of])
        weight /= np.add.reduceat(weight, first)[of]
        z = np.add.reduceat(weight[:, None] * h, first)
        return z @ p["a"] + p["b"], (of, h, t, s, weight, z)

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        logit, (of, h, t, s, weight, z) = self.forward(x, first)
        d_logit = (1 / (1 + np.exp(-logit)) - y) / n
        d_z = (d_logit[:, None] * p["a"])[of]
        d_weight = (h * d_z).sum(axis=1)
        d_e = weight * (d_weight - np.add.reduceat(weight * d_weight, first)[of])
        d_ts = d_e[:, None] * p["u"]
        d_v, d_u = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
        d_in = (weight[:, None] * d_z + d_v @ p["V"].T + d_u @ p["U"].T) * (1 - h * h)
        return {"W": ((x - self.mean) / self.scale).T @ d_in, "w0": d_in.sum(axis=0), "V": h.T @ d_v, "U": h.T @ d_u,
                "u": (d_e[:, None] * t * s).sum(axis=0), "a": z.T @ d_logit, "b": d_logit.sum()}

    def train(self, bags: list[np.ndarray], y: np.ndarray, rules: QualityRules) -> None:
        r = np.random.default_rng(rules.seed)
        moment = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, rules.steps + 1):
            rows = r.integers(0, len(y), rules.batch)
            g = self.gradient(*flat([bags[i] for i in rows]), y[rows])
            rate = rules.rate * (1 - step / (rules.steps + 1))
            for k in self.NAMES:
                moment[k] = 0.9 * moment[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                move = moment[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
                self.p[k] = self.p[k] - rate * (move + rules.decay * self.p[k])

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(*flat(bags))[0], -30, 30)))


def flat(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All passages of all bags, and the first of each bag."""
    return np.concatenate(bags), np.concatenate(([0], np.cumsum([len(b) for b in bags])))[:-1]


def _encoded(batches: Iterator[pa.RecordBatch], rules: QualityRules) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [encode(value or b"", rules.passage).astype(np.float32).tobytes() for value in utf8(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch.column(1).cast(pa.int64())], ["bag", "label"])


def fit(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> AttentionModel | None:
    """Model of `docs` (doc_id, text) and `labels` (doc_id, label 0 or 1); None without labelled rows."""
    rows = labelled_sample(docs, labels, rules.fit_rows).mapInArrow(lambda b: _encoded(b, rules), "bag binary, label bigint").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["label", "bag"])
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in rows["bag"]]
    every = np.concatenate(bags)
    model = AttentionModel(rules, every.mean(axis=0, dtype=float), every.std(axis=0, dtype=float) + 1e-3)
    model.train(bags, rows["label"].to_numpy(float), rules)
    return model


def scored(docs: DataFrame, model: AttentionModel | None, rules: QualityRules = QualityRules(), score: str = "score") -> DataFrame:
    """`docs` with the score of each text."""
    if model is None:
        return docs.withColumn(score, F.lit(0.0))

    @F.arrow_udf("double")
    def udf(text: pa.Array) -> pa.Array:
        out, bags, rows = [], [], 0
        for value in utf8(text):
            bags.append(encode(value or b"", rules.passage))
            rows += len(bags[-1])
            if rows > 20_000:
                out.append(model.score(bags))
                bags, rows = [], 0
        if bags:
            out.append(model.score(bags))
        return pa.array(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(score, udf("text"))
