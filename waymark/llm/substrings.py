"""Long repeated passages, by an FM-index for each shard.

A window is `window` words in a row. The operator finds every window that also starts in a document with a smaller id, and
the words that such windows cover.

1. Every window has an anchor: the run of `anchor` words in it with the smallest hash. Equal windows have equal anchors.
   Consecutive windows with the same anchor make a segment, so a text of n words has about 2 n / (window - anchor) of
   them. Anchors that occur in one document only hold no repeats; their segments are dropped before any text moves.
2. Segments with the same words are one text to the index, with the smallest id that has it. Texts are dealt to shards by
   anchor. An anchor with very many texts is spread over more shards, each of which indexes a part of the texts and is
   asked for all of them.
3. A shard sorts its suffixes up to `window` words, keeps the Burrows-Wheeler transform as a wavelet tree, and streams the
   texts through it from right to left. Backward search extends the match by one word; where that fails, the match is cut
   to the next shorter interval that the sorted suffixes share, so each position ends with the longest match that starts
   there, up to `window` words. Intervals at that threshold are reported with the smallest id among their suffixes.
4. Back at the documents, windows whose smallest id is below the document's own are removed.

Null texts have no words. Rows without an id are never compared. Rows that repeat an id and a text get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import hashes, mixed, run_hashes, small, travels, utf8
from waymark.materialize import Written

travels(__name__)


@dataclass(frozen=True)
class PassageRules:
    window: int = 50
    anchor: int = 12
    #: Texts of one anchor in one shard; more are spread.
    spread: int = 4_096
    #: Words that a task indexes at once.
    shard_words: int = 120_000


def segments(codes: np.ndarray, rules: PassageRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first word, number of words) of the segments of a text, given its word hashes."""
    n_windows = len(codes) - rules.window + 1
    if n_windows < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = run_hashes(codes, rules.anchor)
    span = rules.window - rules.anchor + 1
    # Leftmost smallest hash of each window, by doubling: best[i] covers h[i : i + width].
    best, width = np.arange(len(h)), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        width += step
    change = np.flatnonzero(best[1:] != best[:-1]) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change, [n_windows]))
    return h[best[first]].view(np.int64), first, last - first + rules.window - 1


def _scan(batches: Iterator[pa.RecordBatch], rules: PassageRules) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, n_words, sha, anchors, texts, starts, sizes): what each document has, without its text."""
    for batch in batches:
        n_words, sha, anchors, texts, starts, sizes = [], [], [], [], [], []
        for known, value in zip(batch.column(0).is_valid().to_pylist(), utf8(batch.column(2))):
            words = (value or b"").split()
            n_words.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            if not known or len(words) < rules.window:
                found = [np.empty(0, np.int64)] * 4
            else:
                codes = hashes(words)
                a, s, m = segments(codes, rules)
                # A polynomial of the words tells texts apart.
                found = [a, _text_codes(codes, s, m), s, m]
            for out, values in zip((anchors, texts, starts, sizes), found):
                out.append(values)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(sha, pa.string()),
            *[pa.array(x, pa.list_(pa.int64())) for x in (anchors, texts, starts, sizes)]],
            ["doc_id", "row", "n_words", "sha", "anchors", "texts", "starts", "sizes"])


def _text_codes(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each stretch: a polynomial of its word hashes, from running sums."""
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    n = len(codes) + 1
    up, down = np.full(n, base), np.full(n, inverse)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[:-1])))
    return mixed((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64)).view(np.int64)


class Wavelet:
    """Rank of any symbol in a sequence: one row of bits for each bit of the symbols, most significant first.

    Bits lie in words of 64 with the number of ones before each word.
    """

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.rows, self.before, self.zeros = bits, [], [], []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b & 1).astype(np.uint8)
            packed = np.packbits(np.pad(bit, (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
            self.rows.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1])))
            self.zeros.append(len(bit) - int(bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.rows[level][word] & below)

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the part of the sequence before each position ends, among the occurrences of the symbol in the last order."""
        for level in range(self.bits):
            ones = self.ones(level, at)
            at = np.where(symbol >> (self.bits - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Texts over words 1, 2, ...; each text ends with 0. Suffixes are sorted by their first `depth` words."""

    def __init__(self, sequence: np.ndarray, owner: np.ndarray, depth: int, top: int):
        """`owner` has the document of each position, `top` is the largest word that will be asked for."""
        n = len(sequence)
        self.n, self.depth = n, depth
        rank, width, ranks = np.unique(sequence, return_inverse=True)[1].astype(np.int64), 1, []
        while True:
            ranks.append((width, rank))
            if width == depth:
                break
            step = min(width, depth - width)
            far = np.full(n, -1, np.int64)
            far[:n - step] = rank[step:]
            rank = np.unique(rank * (n + 1) + far + 1, return_inverse=True)[1].astype(np.int64)
            width += step
        self.suffixes = np.argsort(rank, kind="stable")
        # A suffix past the end of its text compares what follows; the reader never asks beyond an end mark.
        self.wavelet = Wavelet(sequence[self.suffixes - 1], max(1, top.bit_length()))
        # Backward search adds how often a word stands before a place to where the suffixes with that word begin.
        words = np.arange(top + 1)
        begin = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=top + 1))[:-1]))
        self.begin = begin - self.wavelet.down(words, np.zeros_like(words))
        self.shared = self._shared(ranks)
        groups = np.concatenate(([0], np.flatnonzero(self.shared[1:n] < depth) + 1))
        self.group = np.cumsum(np.concatenate(([0], (self.shared[1:n] < depth).astype(np.int64))))
        self.smallest = np.minimum.reduceat(owner[self.suffixes], groups)
        self.edges = {}

    def _shared(self, ranks: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Words, up to `depth`, that suffix i shares with suffix i - 1 in the order; 0 at both ends."""
        a, b, out = self.suffixes[:-1].copy(), self.suffixes[1:].copy(), np.zeros(self.n - 1, np.int64)
        same_all = ranks[-1][1][a] == ranks[-1][1][b]
        for width, rank in reversed(ranks):
            if width & (width - 1):
                continue
            while True:
                fits = (a < self.n) & (b < self.n) & (out + width <= self.depth)
                fits[fits] = rank[a[fits]] == rank[b[fits]]
                if not fits.any():
                    break
                a[fits] += width
                b[fits] += width
                out[fits] += width
        out[same_all] = self.depth
        return np.concatenate(([0], out, [0]))

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place in the order, the interval of suffixes that share `depth` words with it."""
        if depth not in self.edges:
            opens = self.shared[:self.n] < depth
            starts, which = np.flatnonzero(opens), np.cumsum(opens) - 1
            ends = np.append(starts[1:], self.n)
            self.edges[depth] = (starts[which].astype(np.int32), ends[which].astype(np.int32))
        return self.edges[depth]

    def cut(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first `depth` words of what [low, high) matches."""
        out_low, out_high = np.zeros_like(low), np.full_like(high, self.n)
        for d in np.unique(depth[depth > 0]).tolist():
            at = np.flatnonzero(depth == d)
            a, b = self.bounds(d)
            out_low[at], out_high[at] = a[low[at]], b[low[at]]
        return out_low, out_high

    def statistics(self, texts: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the given stretches of `texts`: length of the longest match up to `depth`, and the first suffix of its interval.

        All stretches are read at once, from their last word to their first.
        """
        length, place = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        low, high, depth = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64), np.zeros(len(start), np.int64)
        for back in range(1, int(size.max(initial=0)) + 1):
            live = np.flatnonzero(size >= back)
            at = start[live] + size[live] - back
            full = depth[live] == self.depth
            if full.any():
                one = live[full]
                low[one], high[one] = self.cut(low[one], high[one], np.full(len(one), self.depth - 1))
                depth[one] -= 1
            pending = np.arange(len(live))
            while len(pending):
                who = live[pending]
                symbol = texts[at[pending]]
                both = self.wavelet.down(np.concatenate((symbol, symbol)), np.concatenate((low[who], high[who])))
                a, b = both[:len(who)] + self.begin[symbol], both[len(who):] + self.begin[symbol]
                fits = b > a
                low[who[fits]], high[who[fits]] = a[fits], b[fits]
                depth[who[fits]] += 1
                # The match gets shorter by what its interval's neighbours lack.
                failed = who[~fits]
                shorter = np.maximum(self.shared[low[failed]], self.shared[high[failed]])
                shorter = np.where(depth[failed] > 0, np.minimum(shorter, depth[failed] - 1), -1)
                low[failed], high[failed] = self.cut(low[failed], high[failed], shorter)
                depth[failed] = np.maximum(shorter, 0)
                pending = pending[~fits][shorter >= 0]
            length[at], place[at] = depth[live], low[live]
        return length, place


def _search(texts: list[np.ndarray], owner: np.ndarray, indexed: np.ndarray, asked: np.ndarray, rules: PassageRules) -> tuple[np.ndarray, ...]:
    """Runs (text, from window, to window, smallest id) of windows of the asked texts in the indexed ones; `owner` has each text's id."""
    size = np.array([len(t) for t in texts])
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    body = np.zeros(int((size + 1).sum()), np.int64)
    inside = np.ones(len(body), bool)
    inside[start + size] = False
    body[inside] = np.unique(np.concatenate(texts), return_inverse=True)[1] + 1
    of = np.repeat(np.arange(len(texts)), size + 1)
    part = indexed[of]
    index = FMIndex(body[part], owner[of[part]], rules.window, int(body.max()))
    length, place = index.statistics(body, start[asked], size[asked])
    hit = np.flatnonzero(length == rules.window)
    text, window, least = of[hit], hit - start[of[hit]], index.smallest[index.group[place[hit]]]
    new = np.ones(len(hit), bool)
    new[1:] = (text[1:] != text[:-1]) | (window[1:] != window[:-1] + 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1 if len(hit) else first
    return text[first], window[first], window[last], least[first]


def _shards(batches: Iterator[pa.RecordBatch], rules: PassageRules) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, i, j, text, first_id, indexed, asked, words), sorted by group (anchor, i, j): as many whole groups at once as a shard holds."""
    held: list[tuple] = []
    words, key = 0, None

    def searched() -> pa.RecordBatch:
        anchor, _, _, code, first_id, indexed, asked, texts = zip(*held)
        text, low, high, least = _search(
            [np.frombuffer(t, np.int64) for t in texts], np.array(first_id, np.int64), np.array(indexed), np.array(asked), rules)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (np.array(anchor, np.int64)[text], np.array(code, np.int64)[text], low, high, least)], ["anchor", "text", "low", "high", "least"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:3] != key and words >= rules.shard_words:
                yield searched()
                held, words = [], 0
            key = row[:3]
            held.append(row)
            words += len(row[7]) // 8
    if held:
        yield searched()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, text, first_id, words) of documents (doc_id, text, wanted): the wanted stretches as hashes of their words."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for doc_id, value, wanted in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
            if wanted:
                codes = hashes((value or b"").split())
                for w in wanted:
                    for column, x in zip(out, (w["anchor"], w["text"], doc_id, codes[w["start"]:w["start"] + w["size"]].tobytes())):
                        column.append(x)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["anchor", "text", "first_id", "words"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, n_removed, new_sha) of documents (doc_id, row, text, spans)."""
    for batch in batches:
        removed, sha = [], []
        for value, lows, highs in zip(utf8(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            words = (value or b"").split()
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, lows, 1)
            np.add.at(edges, highs, -1)
            keep = np.cumsum(edges[:-1]) == 0
            removed.append(int(len(words) - keep.sum()))
            sha.append(hashlib.sha256(b" ".join(words[i] for i in np.flatnonzero(keep).tolist())).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "row", "n_removed", "new_sha"])


def without_repeats(docs: DataFrame, rules: PassageRules = PassageRules()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row: kept words joined by one blank, as lower-case SHA-256."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    lists = "anchors array<bigint>, texts array<bigint>, starts array<bigint>, sizes array<bigint>"
    scanned = Written(base.mapInArrow(lambda b: _scan(b, rules), f"doc_id bigint, row bigint, n_words bigint, sha string, {lists}")).df
    each = F.explode(F.arrays_zip("anchors", "texts", "starts", "sizes")).alias("s")
    segment = scanned.select("doc_id", "row", each).select(
        "doc_id", "row", F.col("s.anchors").alias("anchor"), F.col("s.texts").alias("text"), F.col("s.starts").alias("start"), F.col("s.sizes").alias("size"))
    shared = segment.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    wanted = Written(segment.join(shared, "anchor", "left_semi")).df

    # The first document with a text stands for it.
    owner = wanted.groupBy("anchor", "text").agg(F.min(F.struct("doc_id", "row", "start", "size")).alias("o"))
    owner = Written(owner.select("anchor", "text", "o.*")).df
    own = owner.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "text", "start", "size")).alias("wanted"))
    affected = wanted.select("doc_id", "row").distinct().join(own, ["doc_id", "row"], "left")
    work = Written(base.join(affected, ["doc_id", "row"]).select("doc_id", "row", "text", "wanted")).df

    crowded = owner.groupBy("anchor").count().filter(F.col("count") > rules.spread)
    crowded = small(Written(crowded.select("anchor", F.ceil(F.col("count") / rules.spread).cast("int").alias("parts"))).df)
    texts = work.select("doc_id", "text", "wanted").mapInArrow(_texts, "anchor bigint, text bigint, first_id bigint, words binary")
    mine = F.pmod(F.col("text"), F.col("parts")).cast("int")
    numbers = F.sequence(F.lit(0), F.col("parts") - 1)
    place = lambda i, j, indexed, asked: F.struct(i.alias("i"), j.alias("j"), indexed.alias("indexed"), asked.alias("asked"))
    places = F.concat(
        F.transform(numbers, lambda j: place(F.col("mine"), j, F.lit(True), j == F.col("mine"))),
        F.transform(F.filter(numbers, lambda i: i != F.col("mine")), lambda i: place(i, F.col("mine"), F.lit(False), F.lit(True))))
    dealt = (
        texts.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", mine)
        .withColumn("p", F.explode(places)).select("anchor", "p.i", "p.j", "text", "first_id", "p.indexed", "p.asked", "words")
    )
    runs = (
        dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
        .mapInArrow(lambda b: _shards(b, rules), "anchor bigint, text bigint, low bigint, high bigint, least bigint")
    )
    spans = (
        wanted.select("doc_id", "row", "anchor", "text", "start").join(Written(runs).df, ["anchor", "text"]).filter("least < doc_id")
        .groupBy("doc_id", "row").agg(
            F.collect_list(F.col("start") + F.col("low")).alias("lows"),
            F.collect_list(F.col("start") + F.col("high") + rules.window).alias("highs"))
    )
    cut = work.select("doc_id", "row", "text").join(spans, ["doc_id", "row"])
    kept = cut.mapInArrow(_kept, "doc_id bigint, row bigint, n_removed bigint, new_sha string").groupBy("doc_id", "row").agg(
        F.max("n_removed").alias("n_removed"), F.max("new_sha").alias("new_sha"))
    return scanned.select("doc_id", "row", "n_words", "sha").join(kept, ["doc_id", "row"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("new_sha", "sha").alias("kept_sha256"))
