import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from waymark.llm import queries, substrings


def brute(rows, window):
    first, out = {}, Counter()
    rows = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in rows:
        for j in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[j:j + window])
            first[key] = min(i, first.get(key, i))
    for i, w in rows:
        keep = [True] * len(w)
        for j in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[j:j + window])] < i:
                keep[j:j + window] = [False] * window
        out[i, len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, k in zip(w, keep) if k)).hexdigest()] += 1
    return out


def result(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("rules", [
    substrings.PassageRules(), substrings.PassageRules(window=6, anchor=3, spread=2, shard_words=200), substrings.PassageRules(window=13, anchor=13, spread=3, shard_words=1)])
def test_removed_words_equal_brute_force(odd, rules):
    assert result(substrings.without_repeats(odd, rules)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()], rules.window)


def test_one_passage_in_most_documents(spark):
    """A shared passage in ever new surroundings, few different words, and edits inside copies."""
    rng = random.Random(1)
    words = lambda n, k=9: [f"v{rng.randrange(k)}" for _ in range(n)]
    passage = words(30)
    rows = []
    for i in range(60):
        middle = list(passage)
        if i % 5 == 0:
            middle[rng.randrange(30)] = "edit"
        rows.append((i, " ".join(words(rng.randrange(12)) + middle + words(rng.randrange(12)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rules = substrings.PassageRules(window=10, anchor=4, spread=5, shard_words=300)
    assert result(substrings.without_repeats(docs, rules)) == brute(rows, 10)


def test_empty_table(nothing):
    assert substrings.without_repeats(nothing).count() == 0


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(12)]
    body = np.concatenate([np.append(t, 0) for t in texts[:8]])
    asked = np.concatenate([np.append(t, 0) for t in texts])
    size = np.array([len(t) for t in texts])
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    for depth in (5, 8, 11):
        index = substrings.FMIndex(body, np.zeros(len(body), np.int64), depth, int(asked.max()))
        length, _ = index.statistics(asked, start, size)
        known = {tuple(t[i:j]) for t in texts[:8] for i in range(len(t)) for j in range(i, len(t) + 1)}
        for t, s in zip(texts, start):
            for i in range(len(t)):
                assert length[s + i] == max(n for n in range(min(depth, len(t) - i) + 1) if tuple(t[i:i + n]) in known)


def test_wavelet_counts():
    values = np.random.default_rng(4).integers(0, 37, 500)
    tree = substrings.Wavelet(values, 6)
    at = np.arange(501)
    for symbol in range(40):
        got = tree.down(np.full(501, symbol), at)
        assert (got - got[0] == np.concatenate(([0], np.cumsum(values == symbol)))).all()


def test_query_of_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert result(queries.op6_substrings(spark, "/root/testdata/sf0.001")) == brute(rows, 50)
