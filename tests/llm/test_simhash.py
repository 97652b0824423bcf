from collections import Counter

import numpy as np
import pytest
import xxhash

from waymark.llm import queries, simhash


def brute(rows, width=3, radius=2):
    prints = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        parts = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        count = [0] * 64
        for p in parts:
            h = xxhash.xxh64_intdigest(p, 42)
            for b in range(64):
                count[b] += h >> b & 1
        prints.append(sum(1 << b for b in range(64) if 2 * count[b] > len(parts)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, prints[i], least.get(find(i))) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("block_rows", [4096, 2])
def test_classes_equal_brute_force(odd, block_rows):
    got = simhash.near_duplicates(odd, block_rows=block_rows).collect()
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert Counter((r["doc_id"], r["print"] % (1 << 64), r["component_id"]) for r in got) == want


def test_crowded_key_is_dealt_out_and_chains_are_followed(spark):
    """Fingerprints one bit apart in a chain, and a far one under the same keys."""
    chain = [0]
    for b in range(40):
        chain.append(chain[-1] ^ (1 << b))
    rows = [(p - (1 << 64) if p >> 63 else p, []) for p in [*chain, (1 << 63) | (1 << 50) | (1 << 45)]]
    prints = spark.createDataFrame(rows, "print bigint, keys array<bigint>")
    links = simhash.links(prints, simhash.SimHashRules(), block_rows=3).collect()
    reached, more = {0}, True
    while more:
        size = len(reached)
        for r in links:
            if r["u"] in reached or r["v"] in reached:
                reached |= {r["u"], r["v"]}
        more = len(reached) > size
    assert reached == set(chain)


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 12, 31])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    seed = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = np.concatenate([seed, seed ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)), rng.integers(0, 1 << 63, 150, dtype=np.uint64)])
    n = len(prints)
    label = simhash.forest(prints, np.arange(n) + 1, np.full(n, n), radius)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    for _ in range(10):
        near = (near.astype(int) @ near.astype(int)) > 0
    assert ((label[:, None] == label[None, :]) == near).all()


def test_bands_group_near_copies_and_one_of_each_stays(odd):
    rules = simhash.SimHashRules(width=5, radius=12, bands=(12, 2))
    classes = {(r["doc_id"]): r["component_id"] for r in simhash.near_duplicates(odd, rules).collect() if r["doc_id"] is not None}
    assert classes[5] == classes[6] == classes[15] == 4 and classes[11] == 10 and classes[1] == classes[2] == 0
    assert classes[3] == 3 and classes[100] == 100
    kept = simhash.one_of_each(odd, rules)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[4] == 1 and ids[17] == 1 and not {5, 6, 11, 15, 1, 2} & set(ids) and ids[None] == 2


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.one_of_each(nothing).columns == nothing.columns


def test_query_of_the_whole_table(spark):
    got = queries.op1_simhash(spark, "/root/testdata/sf0.001").collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert Counter((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == brute(rows)


@pytest.mark.parametrize("blocks", [(4096, 1 << 21), (4, 600)])
def test_similar_links_equal_brute_force_jaccard(spark, blocks):
    """Pairs planted at similarities from 0.5 to 0.95 in steps of 0.05, some short; classes are those of all pairs at 0.8 or more."""
    rng, texts = np.random.default_rng(9), []
    for n in (12, 60, 300):
        for k, s in enumerate(np.repeat(np.arange(0.5, 0.96, 0.05), 4)):
            base = [f"{n}x{k}x{i}" for i in range(n)]
            same = round((n - 4) * 2 * s / (1 + s)) + 4
            texts += [" ".join(base), " ".join(base[:same] + [f"{n}y{k}y{i}" for i in range(n - same)])]
    crowd = [f"c{i}" for i in range(200)]
    texts += [" ".join(crowd[:p] + [f"z{p}"] + crowd[p:]) for p in rng.integers(0, 200, 30)] + [" ".join(crowd[:100] * 3), " ".join(crowd[:100] * 8)]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")
    rules = simhash.SimHashRules(width=5, radius=28, bands=(12, 2), similarity=0.8)
    made = docs.select("doc_id", simhash._print_udf(rules)("text").alias("p")).select("doc_id", "p.*").localCheckpoint()
    links = simhash.similar_links(docs, made, rules, *blocks).collect()
    sets = {}
    for t in texts:
        h = np.unique(simhash.shingle_hashes(t.encode(), 5))
        sets[int(np.uint64(simhash.set_name(h)).astype(np.int64))] = set(h.tolist())
    names = list(sets)

    def classes(pairs):
        label = {x: x for x in names}
        for a, b in pairs:
            old, new = label[a], label[b]
            label |= {x: new for x in names if label[x] == old}
        return {frozenset(x for x in names if label[x] == r) for r in label.values()}

    near = [(a, b) for i, a in enumerate(names) for b in names[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) > 60 and classes((r["u"], r["v"]) for r in links) == classes(near)


def test_templates_stay_and_real_copies_go(spark):
    """Texts that share two thirds of their shingles are no copies; those that share 0.85 are."""
    body = [f"t{i}" for i in range(240)]
    template = [(i, " ".join(body + [f"o{i}x{j}" for j in range(50)])) for i in range(1, 21)]
    copies = [(100 + i, " ".join([f"p{i}x{j}" for j in range(280)] + [f"q{i % 2}x{i}x{j}" for j in range(20)])) for i in range(20)]
    copies += [(200 + i, " ".join([f"p{i}x{j}" for j in range(280)] + [f"r{i}x{j}" for j in range(20)])) for i in range(20)]
    docs = spark.createDataFrame(template + copies, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(docs, simhash.SimHashRules(width=5, radius=28, bands=(12, 2), similarity=0.8)).collect()}
    assert kept == {i for i, _ in template} | {100 + i for i in range(20)}
