import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from waymark.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, path string, key int"


def rows(seed=8, convs=260):
    rng = random.Random(seed)
    out = []
    for c in range(-3, convs):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            # Few different turns, so that conversations share much.
            out.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "", "Ü😀"])))
    # A crowd of copies, a long conversation and one that it begins with, odd values, repeated rows.
    out += [(10_000 + 100 * i, t, "user", f"copy {t}") for i in range(150) for t in range(3)]
    out += [(20_000, t, "user", "x") for t in range(70)] + [(30_000, t, "user", "x") for t in range(66)]
    return out + [(40_001, None, "user", "n"), (40_001, 0, None, None), (40_001, 0, "user", "n"), (40_001, 0, "user", "n"), (None, 0, "user", "a"), (40_000, None, None, "only"), (50_007, 3, "user", "w" * 100_000)]


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        hundred = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(turns.get(hundred, [])[:h] + own[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[b] for b in below)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -(10 ** 9), len(m), len(children.get(node, [])), leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if paths[c] == node).encode()).hexdigest())
        for node, m in members.items())


def nodes(spark, rows, rules):
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA).repartition(4)
    base, shared = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    found = prefixes.trie(prefixes.rebuilt(prefixes.paths_of(df), base, shared, 5), rules)
    return sorted(tuple(-(10 ** 9) if x is None else x for x in r) for r in found.collect())


@pytest.mark.parametrize("rules", [prefixes.TrieRules(), prefixes.TrieRules(block_items=5, chunk_bytes=30, salts=2), prefixes.TrieRules(block_items=40, block_bytes=200)])
def test_nodes_equal_brute_force(spark, rules):
    assert nodes(spark, rows(), rules) == brute(rows())


def test_only_copies_and_empty_table(spark):
    copies = [(i * 100, t, "user", "same") for i in range(50) for t in range(2)]
    assert nodes(spark, copies, prefixes.TrieRules(block_items=6)) == brute(copies)
    assert nodes(spark, [], prefixes.TrieRules()) == []


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_of_any_size_give_the_same_forest(block):
    rng = random.Random(block)
    paths = sorted({b"".join(bytes([rng.randrange(3)]) * 16 + (rng.randrange(1, 2)).to_bytes(4, "big") for _ in range(rng.randrange(7))) for _ in range(120)})
    extras = [[{"depth": len(p) // prefixes.TURN, "n": 1 + i % 3, "low": i, "kids": 0, "leaves": 0, "saved": 0, "ends": f"e{i}"}] for i, p in enumerate(paths)]
    whole, rest = prefixes.forest(paths, [list(e) for e in extras], True, True)
    assert not rest
    found, items = [], []
    for i in range(0, len(paths), block):
        nodes, open_ = prefixes.forest(paths[i:i + block], extras[i:i + block], False, True)
        found += nodes
        items += open_
    found += prefixes.forest([p for p, _ in items], [e for _, e in items], True, True)[0]
    lows = {n[8]: n[0] for n in found}
    assert len(lows) == len(found)
    settled = lambda nodes: sorted((n[0], n[1], -1 if n[1] == 0 else n[2] if n[2] is not None else lows[n[9]], *n[3:9]) for n in nodes)
    assert settled(found) == settled(whole)
