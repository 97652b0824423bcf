"""Near-duplicates by SimHash, compared bit-sliced.

A fingerprint has one bit for each bit of the shingles' hashes: 1 where over half the hashes have it. Two
fingerprints link at `radius` or fewer differing bits, and documents with the same fingerprint always do.

Only fingerprints that share a blocking key are compared. Two kinds of keys are offered:

* `blocks`: the 64 bits are cut into radius + 2 blocks. Two fingerprints within the radius agree on two blocks at
  least, so all pairs of blocks as keys lose no link. For small radii.
* `bands`: MinHash bands of the same shingles, for radii too wide for blocks. A pair whose shingle sets have
  similarity s meets with probability 1 - (1 - s ** rows) ** bands.

With `similarity`, fingerprints only sort out: classes are of sets of shingles, a fingerprint counts every shingle of a
set once, and a pair within `radius` links if the Jaccard similarity of its two sets, computed in full, is at least that.

Fingerprints under one key lie side by side as bit planes: lane by lane, 64 to a word. A fingerprint meets 64 others
at once: plane by plane the differing bits are added to vertical counters by carry-save steps, and words whose lanes
all exceed the radius are left. Keys with many fingerprints are dealt out as pairs of blocks of bounded size. Every
task returns a spanning forest of the links it has found, never the pairs.

Null texts have no words; documents without words have fingerprint zero. Ids that are null take part but name no class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import mixed, small, travels, utf8
from waymark.materialize import Written
from waymark.operators.components import label_components, smallest_reachable

travels(__name__)

SEED = 42
#: Fingerprints of one key that are compared in one go; more are dealt out as pairs of blocks.
BLOCK_ROWS = 4096
#: Words of 64 lanes that are worked on at once.
ITEMS = 1 << 16
#: Shingles of the sets of one key that are compared in one go, and shingles that are looked up at once.
BLOCK_SHINGLES = 1 << 21
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class SimHashRules:
    width: int = 3
    radius: int = 2
    #: (bands, rows of a band), or None for blocks of the fingerprint.
    bands: tuple[int, int] | None = None
    #: Least Jaccard similarity of a link between sets of shingles (with bands only), or None to link by fingerprints.
    similarity: float | None = None


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of `width` words joined by blanks, A-Z lower-cased; of all words where they are fewer."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(width, n)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[:n - width + 1].tolist(), ends[width - 1:].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n - width + 1)


def majority(h: np.ndarray) -> int:
    """The fingerprint of a document's hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = np.ascontiguousarray(h[at:at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def band_keys(h: np.ndarray, bands: int, rows: int) -> list[int]:
    """One key for each band, of the smallest hashes under `rows` scrambles."""
    odd = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.array([(h * a).min() for a in odd], np.uint64).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mixed(key + least[:, r])
    return key.view(np.int64).tolist()


def set_name(h: np.ndarray) -> int:
    """A name for a set of shingles, from its sorted hashes."""
    return xxhash.xxh64_intdigest(h.tobytes(), SEED)


def _print_udf(rules: SimHashRules):
    kind = "struct<print:bigint,keys:array<bigint>,node:bigint,n:bigint>"

    @F.arrow_udf(kind)
    def prints(text: pa.Array) -> pa.Array:
        found, keys, nodes, sizes = [], [], [], []
        for value in utf8(text):
            h = shingle_hashes(value or b"", rules.width)
            own = np.unique(h) if rules.bands else h
            found.append(majority(own if rules.similarity else h) if len(h) else 0)
            keys.append(band_keys(own, *rules.bands) if rules.bands and len(h) else [])
            nodes.append(set_name(own) if rules.similarity else found[-1])
            sizes.append(len(own))
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return pa.StructArray.from_arrays(
            [signed(found), pa.array(keys, pa.list_(pa.int64())), signed(nodes), pa.array(sizes, pa.int64())], ["print", "keys", "node", "n"])

    return prints


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of each text: the name of its set, and the sorted hashes as bytes."""
    for batch in batches:
        nodes, shingles, size = [], [], 0
        for value in utf8(batch.column(0)):
            h = np.unique(shingle_hashes(value or b"", width))
            nodes.append(set_name(h))
            shingles.append(h.tobytes())
            size += len(h)
            if size >= BLOCK_SHINGLES:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(shingles, pa.binary())], ["node", "shingles"])
                nodes, shingles, size = [], [], 0
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(shingles, pa.binary())], ["node", "shingles"])


def planes_of(prints: np.ndarray) -> np.ndarray:
    """64 bit planes of as many lanes as there are fingerprints, in words of 64."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    spare = -len(prints) % 64
    packed = np.packbits(np.pad(bits, ((0, 0), (0, spare))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def near_lanes(prints: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, lane) within the radius, of the `alive` lanes of each (query, word).

    The counters start so high that adding one difference too many carries out of their last bit.
    """
    size = max(1, radius.bit_length())
    start = (1 << size) - 1 - radius
    counters = [np.full(len(query), ALL if start >> b & 1 else 0, np.uint64) for b in range(size)]
    for p in range(64):
        differ = planes[p, word] ^ (np.uint64(0) - (prints[query] >> np.uint64(p) & np.uint64(1)))
        for b in range(size):
            carry = counters[b] & differ
            counters[b] ^= differ
            differ = carry
        alive = alive & ~differ
        if p % 8 == 7:
            left = np.flatnonzero(alive)
            if len(left) == 0:
                return left, left
            if len(left) < 0.75 * len(alive):
                query, word, alive = query[left], word[left], alive[left]
                counters = [c[left] for c in counters]
    hit = np.flatnonzero(alive)
    bits = np.unpackbits(np.ascontiguousarray(alive[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(bits)
    return query[hit][at], word[hit][at] * 64 + lane


def near_pairs(prints: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius; row i is compared with rows first[i] to last[i] - 1."""
    planes = planes_of(prints)
    rows = np.flatnonzero(last > first)
    from_word, words = first[rows] // 64, (last[rows] - 1) // 64 - first[rows] // 64 + 1
    total = np.concatenate(([0], np.cumsum(words)))
    for at in range(0, int(total[-1]), ITEMS):
        item = np.arange(at, min(at + ITEMS, int(total[-1])))
        which = np.searchsorted(total, item, side="right") - 1
        query, word = rows[which], from_word[which] + item - total[which]
        low = np.clip(first[query] - word * 64, 0, 63).astype(np.uint64)
        high = np.clip(last[query] - word * 64, 1, 64).astype(np.uint64)
        alive = (ALL << low) & (ALL >> (np.uint64(64) - high))
        a, b = near_lanes(prints, planes, query, word, alive, radius)
        if len(a):
            yield a, b


def forest(prints: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> np.ndarray:
    """For each row a row that it is linked with, directly or not; row i is compared with rows first[i] to last[i] - 1."""
    n = len(prints)
    label = np.arange(n)
    for a, b in near_pairs(prints, first, last, radius):
        label = smallest_reachable(label[a], label[b], n)[label]
    return label


def similar(one: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of `others` have at least the Jaccard similarity `least` to `one`; all are sorted and not empty."""
    both, at = np.zeros(len(others), np.int64), 0
    n = np.fromiter(map(len, others), np.int64, len(others))
    ends = np.cumsum(n)
    while at < len(others):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + BLOCK_SHINGLES, side="right")))
        every = np.concatenate(others[at:to])
        hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
        both[at:to] = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(n[at:to])[:-1])), dtype=np.int64)
        at = to
    return both >= least * (len(one) + n - both)


def verified_forest(prints: np.ndarray, sets: list[np.ndarray], low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int, least: float) -> np.ndarray:
    """As `forest`, with pairs linked by the similarity of their sets; row i is in the group of rows low[i] to high[i] - 1.

    Pairs that are linked already, directly or not, need no comparison.
    """
    label, n = np.arange(len(prints)), np.fromiter(map(len, sets), np.int64, len(sets))
    for a, b in near_pairs(prints, first, last, radius):
        # No two sets are more similar than their sizes.
        may = np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b])
        a, b = a[may], b[may]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        bounds = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True]))) if len(a) else []
        for x, y in zip(bounds[:-1], bounds[1:]):
            one, others = a[x], b[x:y]
            others = others[label[others] != label[one]]
            if len(others) == 0:
                continue
            linked = others[similar(sets[one], [sets[k] for k in others], least)]
            if len(linked):
                own = label[low[one]:high[one]]
                roots = np.unique(label[np.append(linked, one)])
                own[np.isin(own, roots)] = roots[0]
    return label


def _edges(batches: Iterator[pa.RecordBatch], radius: int, similarity: float | None = None) -> Iterator[pa.RecordBatch]:
    """Links of the rows (key, i, j, side, print), sorted so. Side 1 is met by side 0; a group with one side meets itself.

    With `similarity`, rows go on with (node, shingles), and links are between nodes.
    """
    held: list[np.ndarray] | None = None

    def links(c: list[np.ndarray]) -> pa.RecordBatch:
        prints = c[4].view(np.uint64)
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in c[:3]], axis=0)) + 1
        bounds = np.concatenate(([0], change, [len(prints)]))
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        last = bounds[1:][group]
        split = np.add.reduceat(1 - c[3], bounds[:-1])[group] + bounds[:-1][group]
        first = np.where(c[1] == c[2], np.arange(len(prints)) + 1, split)
        last_met = np.where(c[3] == 1, 0, last)
        if similarity is None:
            label, name = forest(prints, first, last_met, radius), c[4]
        else:
            sets = [np.frombuffer(x, np.uint64) for x in c[6]]
            label, name = verified_forest(prints, sets, bounds[:-1][group], last, first, last_met, radius, similarity), c[5]
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(name[moved]), pa.array(name[label[moved]])], ["u", "v"])

    for batch in batches:
        c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if len(c[0]) == 0:
            continue
        if held is not None:
            c = [np.concatenate(x) for x in zip(held, c)]
        same = np.logical_and.reduce([x == x[-1] for x in c[:3]])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = [x[cut:] for x in c]
        if cut:
            yield links([x[:cut] for x in c])
    if held is not None:
        yield links(held)


def _thin(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links of a task, for every `most` links at a time."""
    held = np.empty((2, 0), np.int64)

    def forest_of(links: np.ndarray) -> np.ndarray:
        nodes, code = np.unique(links, return_inverse=True)
        code = code.reshape(2, -1)
        label = smallest_reachable(code[0], code[1], len(nodes))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return np.stack([nodes[moved], nodes[label[moved]]])

    def rows(links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["u", "v"])

    for batch in batches:
        held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        if held.shape[1] >= most:
            held = forest_of(held)
            if held.shape[1] >= most // 2:
                yield rows(held)
                held = held[:, :0]
    if held.shape[1]:
        yield rows(forest_of(held))


def _block_keys(radius: int):
    """Array of keys: all pairs of the fingerprint's radius + 2 blocks."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(i), blocks[a], blocks[b]) for i, (a, b) in enumerate(combinations(range(n), 2))])


def links(prints: DataFrame, rules: SimHashRules, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (u, v) between fingerprints of (print, keys) that span every class of them."""
    keys = F.col("keys") if rules.bands else _block_keys(rules.radius)
    rows = Written(prints.select("print", F.explode(keys).alias("key")).distinct()).df
    sizes = rows.groupBy("key").count().filter(F.col("count") > 1)
    parts = F.ceil(F.col("count") / block_rows).cast("long")
    own = F.pmod(F.xxhash64("print"), "parts")
    dealt = (
        rows.join(sizes.select("key", parts.alias("parts")), "key")
        .select("key", "print", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                (F.col("own") > F.col("other")).cast("long").alias("side"), "print")
    )
    radius = rules.radius
    return (
        dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
        .mapInArrow(lambda batches: _edges(batches, radius), "u bigint, v bigint")
        # A fingerprint may be linked under every key; one forest of them all is enough.
        .repartition("u").mapInArrow(_thin, "u bigint, v bigint")
    )


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of `nodes` (node, doc_id), read again from a text of each; texts without an id are all read."""
    ids = small(nodes.filter("doc_id is not null").select("doc_id").distinct())
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null").select("doc_id", "text"))
    sets = texts.select("text").mapInArrow(lambda batches: _sets(batches, width), "node bigint, shingles binary")
    return sets.join(small(nodes.select("node")), "node", "left_semi").dropDuplicates(["node"])


def similar_links(docs: DataFrame, prints: DataFrame, rules: SimHashRules, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (u, v) between sets of shingles that span every class of them, for (doc_id, print, keys, node, n) of `docs`."""
    rows = Written(prints.select("node", "print", "n", F.explode("keys").alias("key")).distinct()).df
    sizes = rows.groupBy("key").agg(F.count("*").alias("count"), F.sum("n").alias("shingles")).filter(F.col("count") > 1)
    parts = F.least(F.col("count"), F.greatest(F.ceil(F.col("count") / block_rows), F.ceil(F.col("shingles") / block_shingles))).cast("long")
    met = Written(rows.join(sizes.select("key", parts.alias("parts")), "key")).df
    wanted = prints.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = _sets_of(docs, Written(wanted).df, rules.width)
    own = F.pmod(F.xxhash64("node"), "parts")
    dealt = (
        met.select("key", "node", "print", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                (F.col("own") > F.col("other")).cast("long").alias("side"), "print", "node")
        .join(sets, "node").select("key", "i", "j", "side", "print", "node", "shingles")
    )
    radius, similarity = rules.radius, rules.similarity
    return (
        dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
        .mapInArrow(lambda batches: _edges(batches, radius, similarity), "u bigint, v bigint")
        .repartition("u").mapInArrow(_thin, "u bigint, v bigint")
    )


def near_duplicates(docs: DataFrame, rules: SimHashRules = SimHashRules(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, print, component_id) of every row: the fingerprint as a signed long, and the smallest id of its class."""
    made = docs.select("doc_id", _print_udf(rules)("text").alias("_p")).select("doc_id", "_p.*")
    if rules.similarity:
        prints = Written(made).df
        classes = label_components(similar_links(docs, prints, rules, block_rows))
    else:
        prints = Written(made.select("doc_id", "print", "keys", "node")).df
        classes = label_components(links(prints, rules, block_rows))
    first = prints.groupBy("node").agg(F.min("doc_id").alias("first"))
    linked = Written(classes.join(first, "node").select("node", "root", "first")).df
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    named = linked.join(smallest, "root").select("node", "smallest")
    by_node = first.join(named, "node", "left").select("node", F.coalesce("smallest", "first").alias("component_id"))
    return prints.select("doc_id", "print", "node").join(by_node, "node").select("doc_id", "print", "component_id")


def one_of_each(docs: DataFrame, rules: SimHashRules = SimHashRules()) -> DataFrame:
    """The rows whose id is the smallest of their class, one for each (id, text); rows without an id stay."""
    gone = Written(near_duplicates(docs, rules).filter("doc_id <> component_id").select("doc_id").distinct()).df
    return docs.join(small(gone), "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
