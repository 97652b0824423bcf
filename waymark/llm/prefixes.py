"""The trie of conversation prefixes, from sorted neighbours.

A conversation is a path: a fixed-length entry for each turn, the digest of its role and text and the length of its text. Equal
paths collapse into one item first, so a crowd of copies is one row. Items are sorted by path over range partitions. In each block
of sorted items, the number of turns that neighbours share is an edge between them; union-find goes over these edges in
descending depth. A component is raised from the depth of its topmost node to that of the edge, which gives the nodes between,
and every merge makes a branching node.

Nodes on the path of the first or of the last item of a block may go on in the next block. They are contracted: what the block
knows about them goes with these two paths, as items of the next level, which are sorted, cut into blocks and merged the same way.
Two items are left of each block, so few levels end in a block that has no neighbours. Children of contracted nodes look up
their parent at the end.

Digests are MD5 (128 bits): equal digests and lengths stand for equal turns. A task holds a block of items; a conversation's path, 20 bytes a
turn, is one value. Turns are ordered by turn, null first, then by digest. Null roles and texts count as empty. Repeated rows are
turns of their own. Rows without a conversation take no part. An empty table has no nodes, not even a root. Columns other than conv_id,
turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import small, travels
from waymark.materialize import Written

travels(__name__)

#: Bytes of a turn in a path: a digest and the length of the text.
DIGEST, LENGTH = 16, 4
TURN = DIGEST + LENGTH
NO_ID = (1 << 63) - 1
NO_ENDS = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class TrieRules:
    """`block_items` and `block_bytes` bound what a task holds, `chunk_bytes` the ids that a task joins at once."""

    block_items: int = 8_192
    block_bytes: int = 1 << 25
    chunk_bytes: int = 1 << 20
    salts: int = 16


# Paths


def paths_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the entries of each conversation's turns in order, as text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    entry = F.concat(digest, F.lpad(F.hex(F.length(text)), 2 * LENGTH, "0"))
    # Nulls come first in the order of structs.
    ordered = F.sort_array(F.collect_list(F.struct("turn", entry.alias("entry"))))
    return conversations.filter(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(ordered["entry"].alias("turns"))


def rebuilt(turns: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """`turns` with the first `shared` entries taken from conversation `base`: all of them if it has fewer, none if it's absent.

    No more than `most` turns are shared. A base serves many conversations, so only its first turns move.
    """
    firsts = turns.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_firsts"))
    bases = turns.withColumns({"_base": base, "_shared": shared.cast("int")})
    needed = firsts.join(bases.select("_base").distinct(), "_base", "left_semi")
    own = F.slice("turns", F.col("_shared") + 1, F.greatest(F.size("turns") - F.col("_shared"), F.lit(0)))
    given = F.slice(F.coalesce("_firsts", F.array().cast("array<string>")), F.lit(1), F.col("_shared"))
    return bases.join(needed, "_base", "left").select("conv_id", F.concat(given, own).alias("turns"))


# Ids that end at a path


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in order -> (key, first, ids): the ids of a key, comma-joined, in pieces."""
    key, first, ids, size = None, 0, [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in done]), pa.array([f for _, f, _ in done], pa.int64()), pa.array([t for _, _, t in done])], ["key", "first", "ids"])

    done: list[tuple[str, int, str]] = []
    for batch in batches:
        for own, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (own != key or size >= limit):
                done.append((key, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                key, first = own, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if done:
            yield made()
            done = []
    if ids:
        done.append((key, first, ",".join(ids)))
        yield made()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ids) in order -> (key, ends)."""
    key, digest = None, None
    for batch in batches:
        keys, ends = [], []
        for own, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if own == key:
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                keys.append(key)
                ends.append(digest.hexdigest())
            key, digest = own, hashlib.sha256(ids.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ends)], ["key", "ends"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "ends"])


EXTRA = "struct<depth:bigint,n:bigint,low:bigint,kids:bigint,leaves:bigint,saved:bigint,ends:string>"


def items_of(paths: DataFrame, rules: TrieRules) -> DataFrame:
    """(path, extras): distinct paths, with the number, the smallest id and the hash of all ids of their conversations."""
    stored = Written(paths.select("conv_id", F.unhex(F.array_join("turns", "")).alias("path"))).df
    copies = stored.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low")).withColumn("key", F.md5("path"))
    # A crowd of copies is sorted over several tasks; only its joined ids meet in one, as a hash needs them in order.
    chunks = (
        stored.select(F.md5("path").alias("key"), "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
        .mapInArrow(lambda b: _chunks(b, rules.chunk_bytes), "key string, first long, ids string")
    )
    ends = chunks.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_hashed, "key string, ends string")
    none = F.lit(0).cast("long")
    extra = F.struct((F.length("path") / TURN).cast("long").alias("depth"), "n", "low", none.alias("kids"), none.alias("leaves"), none.alias("saved"), "ends")
    return copies.join(ends, "key").select("path", F.array(extra.cast(EXTRA)).alias("extras"))


# Forests


@dataclass
class Part:
    """A component of items `first` to `last`, raised to its node at `depth`."""

    depth: int
    first: int
    last: int
    #: What is known of nodes above, by depth.
    rest: dict[int, dict]
    n: int = 0
    low: int = NO_ID
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    #: Rows whose parent this node is.
    pending: list[int] = field(default_factory=list)

    def add(self, extra: dict) -> None:
        self.n += extra["n"]
        self.low = min(self.low, extra["low"])
        self.kids += extra["kids"]
        self.leaves += extra["leaves"]
        self.saved += extra["saved"]
        self.ends = self.ends or extra["ends"]

    def known(self) -> dict:
        return {c: getattr(self, c) for c in ("depth", "n", "low", "kids", "leaves", "saved", "ends")}


def _sum(a: dict, b: dict) -> dict:
    out = {c: a[c] + b[c] for c in ("n", "kids", "leaves", "saved")}
    return out | {"depth": a["depth"], "low": min(a["low"], b["low"]), "ends": a["ends"] or b["ends"]}


def _merged(a: Part, b: Part) -> Part:
    """The node that two components at one depth share."""
    if len(a.rest) + len(a.pending) < len(b.rest) + len(b.pending):
        a, b = b, a
    for depth, extra in b.rest.items():
        a.rest[depth] = _sum(a.rest[depth], extra) if depth in a.rest else extra
    a.pending += b.pending
    a.add(b.known())
    a.first, a.last = min(a.first, b.first), max(a.last, b.last)
    return a


def shared_turns(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b)) // TURN
    for d in range(most):
        if a[d * TURN:(d + 1) * TURN] != b[d * TURN:(d + 1) * TURN]:
            return d
    return most


def key_of(path: bytes, depth: int) -> str:
    return hashlib.md5(path[:depth * TURN]).hexdigest()


def forest(paths: list[bytes], extras: list[list[dict]], last_level: bool, keyed: bool) -> tuple[list[list], list[tuple[bytes, list[dict]]]]:
    """Nodes and contracted items of a block of distinct paths in order.

    A node is [conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key, parent_key]; the last two
    name contracted nodes. On the last level nothing is contracted.
    """
    last_item = len(paths) - 1
    nodes: list[list] = []
    spines: tuple[list[dict], list[dict]] = ([], [])
    parts: list[Part | None] = []
    for i, path in enumerate(paths):
        rest = {x["depth"]: x for x in extras[i]}
        part = Part(len(path) // TURN, i, i, rest)
        part.add(rest.pop(part.depth))
        parts.append(part)

    def raised(part: Part, depth: int) -> None:
        while part.depth > depth:
            path = paths[part.first]
            if not last_level and (part.first == 0 or part.last == last_item):
                spines[0 if part.first == 0 else 1].append(part.known())
                for row in part.pending:
                    nodes[row][9] = key_of(path, part.depth)
                part.n, part.low, part.kids, part.leaves, part.saved, part.pending = 0, NO_ID, 0, 0, 0, []
            else:
                if part.depth:
                    part.saved += (part.n - 1) * int.from_bytes(path[part.depth * TURN - LENGTH:part.depth * TURN], "big")
                part.leaves = part.leaves if part.kids else 1
                for row in part.pending:
                    nodes[row][2] = part.low
                nodes.append([part.low, part.depth, None, part.n, part.kids, part.leaves, part.saved, part.ends or NO_ENDS,
                              key_of(path, part.depth) if keyed else None, None])
                part.kids, part.pending = 1, [len(nodes) - 1]
            part.ends = None
            part.depth -= 1
            if part.depth in part.rest:
                part.add(part.rest.pop(part.depth))

    owner = list(range(len(paths)))

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    edges = [shared_turns(a, b) for a, b in zip(paths, paths[1:])]
    for i in sorted(range(len(edges)), key=lambda i: -edges[i]):
        a, b = root(i), root(i + 1)
        raised(parts[a], edges[i])
        raised(parts[b], edges[i])
        # The larger component of the two takes the other's nodes; ids of items do for the tree of owners.
        merged = _merged(parts[a], parts[b])
        owner[b], parts[a], parts[b] = a, merged, None
    raised(parts[root(0)], -1)
    return nodes, [(paths[i], spine) for i, spine in ((0, spines[0]), (last_item, spines[1])) if spine]


NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
        "key string, parent_key string, path binary")
_NODE_TYPES = [pa.int64()] * 7 + [pa.string()] * 3 + [pa.binary()]
_EXTRA_TYPE = pa.list_(pa.struct([(c, pa.int64()) for c in ("depth", "n", "low", "kids", "leaves", "saved")] + [("ends", pa.string())]))


def _forests(batches: Iterator[pa.RecordBatch], rules: TrieRules, last_level: bool, keyed: bool) -> Iterator[pa.RecordBatch]:
    paths: list[bytes] = []
    extras: list[list[dict]] = []
    size = 0

    def block() -> pa.RecordBatch:
        nodes, items = forest(paths, extras, last_level, keyed)
        rows = [[*n, None] for n in nodes] + [[None] * 10 + [path] for path, _ in items]
        known = [None] * len(nodes) + [spine for _, spine in items]
        names = [x.split()[0] for x in NODE.split(", ")]
        return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(zip(*rows), _NODE_TYPES)], pa.array(known, _EXTRA_TYPE)], [*names, "extras"])

    for batch in batches:
        for path, extra in zip(batch.column("path").to_pylist(), batch.column("extras").to_pylist()):
            # The last level is one block, whose items were counted.
            if paths and not last_level and (len(paths) >= rules.block_items or size >= rules.block_bytes):
                yield block()
                paths, extras, size = [], [], 0
            paths.append(path)
            extras.append(extra)
            size += len(path)
    if paths:
        yield block()


def trie(paths: DataFrame, rules: TrieRules = TrieRules()) -> DataFrame:
    """One row for each distinct prefix of `paths` (conv_id, turns as `paths_of` gives them):

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    items, done, level = items_of(paths, rules), [], 0
    while True:
        count = items.count() if level else None
        last_level = level > 0 and count <= rules.block_items
        if last_level:
            ordered = items.repartition(1)
        elif level:
            ordered = items.repartitionByRange(max(1, count // (4 * rules.block_items)), "path")
        else:
            ordered = items.repartitionByRange("path")
        made = Written(ordered.sortWithinPartitions("path").mapInArrow(
            lambda b, last_level=last_level, keyed=level > 0: _forests(b, rules, last_level, keyed), f"{NODE}, extras array<{EXTRA}>")).df
        done.append(made.filter(F.col("path").isNull()).drop("path", "extras"))
        if last_level:
            break
        items, level = made.filter(F.col("path").isNotNull()).select("path", "extras"), level + 1
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    # Contracted nodes: two paths for each block at most. A node with very many children is looked up by several keys.
    every = F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1))).alias("_salt")
    contracted = nodes.filter(F.col("key").isNotNull()).select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"), every)
    found = nodes.withColumn("_salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(rules.salts)).cast("int")).join(small(contracted), ["parent_key", "_salt"], "left")
    return found.select("conv_id", "depth", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_sql() -> str:
    """Checking SQL for conversations rebuilt with the first crc32(id) % 6 turns of the conversation that opens their hundred."""
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""
    return f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT conv_id, length(text) AS chars, md5(length(role) || ':' || role || text) AS digest,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), length(text)) AS pos FROM given),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc} % 6 AS h FROM (SELECT DISTINCT conv_id FROM given)),
turns AS (
  SELECT c.conv_id, 0 AS own, n.pos, n.digest, n.chars FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, n.pos, n.digest, n.chars FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.pos > c.h),
paths AS (
  SELECT conv_id, coalesce(list(digest ORDER BY own, pos) FILTER (digest IS NOT NULL), []) AS path, coalesce(list(chars ORDER BY own, pos) FILTER (digest IS NOT NULL), []) AS chars
  FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
prefixes AS (
  SELECT conv_id, d, md5(array_to_string(path[:d], ',')) AS node, md5(array_to_string(path[:d - 1], ',')) AS parent, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, d = len(path) AS ends
  FROM (SELECT conv_id, path, chars, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS (
  SELECT d, node, CASE WHEN d > 0 THEN min(parent) END AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, node),
counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.parent = n.node AND c.d = n.d + 1) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.parent = p.node AND n.d = p.d + 1),
above AS (
  SELECT DISTINCT a.d AS a_d, a.node AS a_node, b.d, b.node FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND a.d <= b.d)
SELECT t.conv_id, t.d AS depth, t.parent_conv_id, t.n_convs, t.n_children, CAST(sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
  CAST(sum(u.saved) AS BIGINT) AS saved_tokens, t.ends_sha256
FROM counted t JOIN above x ON x.a_d = t.d AND x.a_node = t.node JOIN counted u ON u.d = x.d AND u.node = x.node
GROUP BY t.conv_id, t.d, t.parent_conv_id, t.n_convs, t.n_children, t.ends_sha256, t.node
"""
