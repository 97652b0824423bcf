"""Toxicity and quality: parts against brute force, queries by held-out accuracy."""

import random

import numpy as np
import pytest

from waymark.llm import quality, queries, toxicity


@pytest.fixture(scope="module")
def channel(spark):
    rng = random.Random(1)
    words = ["the", "idiot", "worthless", "class", "book", "cool", "letters", "scum", "said", "to", "a", "lesson"]
    rows = [(" ".join(rng.choice(words) for _ in range(200)),) for _ in range(50)]
    return toxicity.Channel(toxicity.language_model(spark.createDataFrame(rows, "text string")))


def test_restoring(channel):
    assert channel.pieces("1d10t!") == ["idiot"] and channel.pieces("$cum") == ["scum"] and channel.pieces("w0rthle$$,") == ["worthless"]
    assert channel.pieces("idiooooot") == ["idiot"] and channel.pieces("i.d.i.o.t") == ["idiot"]
    assert channel.spaced("an i d i o t said") == ["idiot"] and channel.spaced("a b") == []
    assert channel.pieces("letters.") == ["letters"] and channel.pieces("%%%") == [] and channel.pieces("class") == ["class"]
    assert channel.pieces("it's") == ["it", "s"] and channel.pieces("book&&&") == ["book"] and len("".join(channel.pieces("ab1c" * 5000))) > 0


def test_signs_spacing_and_repetition_together(channel):
    for text in ("1 d 1 0 t", "i  d  i  o  t", "i\td\ti\to\tt", "i-d-1-0-t", "i. d. 1. 0. t", "an 1 d i  0 t said"):
        assert channel.spaced(text) == ["idiot"], text
    assert channel.spaced("$ c u m") == ["scum"] and channel.spaced("s @ i d") == ["said"] and channel.spaced("b o o k") == ["book"]
    assert channel.pieces("sscum") == ["scum"] and channel.pieces("1d10000t") == ["idiot"] and channel.pieces("lesson") == ["lesson"] and channel.pieces("cool") == ["cool"]
    assert channel.spaced("1 2 3 4 5") == [] and channel.spaced("in 3 d and") == []


def test_long_lattices_are_not_cut(channel):
    words = ["idiot", "worthless", "scum", "letters"] * 40
    assert "".join(channel.spaced("   ".join(" ".join(w) for w in words))) == "".join(words)
    assert "".join(channel.pieces("1d10t" * 100)) == "idiot" * 100


def test_viterbi_equals_all_readings(channel):
    import itertools

    def best(word):
        options, last, run, gap = [], "", 0, False
        for c in word:
            known = c in toxicity.STANDS_FOR or c.isalpha()
            run, gap_now = (run + 1 if c == last else 1, gap) if known else (run, False)
            options.append(channel.readings(c, run if known else 0, gap_now))
            last, gap = (c, False) if known else (last, True)
        scores = {}
        for path in itertools.product(*options):
            text = "".join(r for r, _ in path)
            codes = [0, 0, *(int(toxicity.TABLE[b]) for b in text.encode()), 0]
            score = sum(channel.model[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:])) - sum(cost for _, cost in path)
            scores[text] = max(score, scores.get(text, -1e9))
        return scores

    r = random.Random(8)
    for _ in range(300):
        word = "".join(r.choice("abdiotsscu0134$@!. -") for _ in range(r.randrange(1, 9)))
        scores = best(word)
        assert abs(scores[channel.decode(word)] - max(scores.values())) < 1e-6, word


def test_language_model_counts(spark, odd):
    from collections import Counter

    want = Counter()
    for r in odd.collect():
        if r["text"]:
            s = [int(toxicity.TABLE[b]) for b in b"  " + r["text"].encode() + b" "]
            want.update(zip(s, s[1:], s[2:]))
    got = toxicity.language_model(odd)
    a, b = 1, 2
    total = sum(n + 0.0 for (x, y, _), n in want.items() if (x, y) == (a, b)) + 6.4
    assert np.allclose(got[a, b], [np.log((want[a, b, c] + 0.1) / total) for c in range(64)], atol=1e-5)


@pytest.mark.parametrize("name, column, size, least", [("op4_toxicity", "toxic", "sf0.1", 0.98), ("op8_quality", "quality", "sf0.01", 0.97)])
def test_held_out_accuracy(spark, name, column, size, least):
    folder = f"/root/testdata/{size}"
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, folder).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count() and len(held) > 50 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) >= least


def test_odd_rows_and_missing_labels(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (4, 1), (7, 0), (8, 0), (None, 1), (999, 1), (9, None), (1, 0)], "doc_id long, label int")
    for module in (toxicity, quality):
        model = module.fit(odd, labels)
        scores = {(r["doc_id"], r["text"]): r["score"] for r in module.scored(odd.drop("score"), model).collect()}
        assert len(scores) == odd.count() - 1 and all(0 <= s <= 1 for s in scores.values())
        assert scores[0, None] == scores[1, ""] == scores[2, " \t\n\r\x0b\x0c "]
        assert module.scored(nothing, model).count() == 0
        empty = module.fit(odd, labels.limit(0))
        assert {r["score"] for r in module.scored(odd, empty).collect()} == {0.0}


def padded_logits(model, bags):
    """The model bag by bag, padded with a mask."""
    p = model.p
    x, mask = np.zeros((len(bags), max(map(len, bags)), quality.FEATURES)), np.zeros((len(bags), max(map(len, bags))), bool)
    for i, b in enumerate(bags):
        x[i, :len(b)], mask[i, :len(b)] = b, True
    h = np.tanh(((x - model.mean) / model.scale) @ p["W"] + p["w0"])
    e = np.where(mask, (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["u"], -np.inf)
    weight = np.exp(e - e.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    return (weight[:, :, None] * h).sum(axis=1) @ p["a"] + p["b"]


def test_attention_gradient_and_flat_scores():
    rules = quality.QualityRules(hidden=5, gate=3)
    r = np.random.default_rng(0)
    bags = [r.normal(size=(n, quality.FEATURES)) for n in (1, 4, 2)]
    x, first = quality.flat(bags)
    model = quality.AttentionModel(rules, np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = padded_logits(model, bags)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    assert np.allclose(model.score(bags), 1 / (1 + np.exp(-padded_logits(model, bags))))
    gradient = model.gradient(x, first, y)
    for name in model.NAMES:
        flat = model.p[name].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 7)):
            old = flat[i]
            ends = []
            for step in (1e-5, -1e-5):
                changed = flat.copy()
                changed[i] = old + step
                model.p[name] = changed.reshape(model.p[name].shape)
                ends.append(loss())
            model.p[name] = flat.reshape(model.p[name].shape)
            assert abs((ends[0] - ends[1]) / 2e-5 - gradient[name].reshape(-1)[i]) < 1e-6


def plain_encode(text, passage):
    """`encode` word by word."""
    import re

    kind = lambda b: quality.KINDS[quality.TABLE[b]]
    found = [(m.start(), m[0]) for m in re.finditer(rb"[^ \t\n\r\v\f]+", text)]
    if not found:
        return [[0.0] * quality.FEATURES]
    cuts = list(range(0, len(found), passage))
    out, before = [], 0.0
    for k, i in enumerate(cuts):
        words = [w for _, w in found[i:i + passage]]
        body = text[found[i][0] if k else 0:found[i + passage][0] if i + passage < len(found) else len(text)]
        n, sizes = len(words), [len(w) for w in words]
        mean = sum(sizes) / n
        different = len(set(words)) / n
        marked = sum(quality.TABLE[w[-1]] >= quality.KINDS.index("sign") and kind(w[-1]) != "wide" for w in words)
        out.append([sum(kind(b) == name for b in body) / len(body) for name in quality.KINDS] + [
            np.log1p(n) / 4, mean / 10, min((sum(v * v for v in sizes) / n - mean * mean) ** 0.5 if len(set(sizes)) > 1 else 0.0, 20) / 10, different,
            sum(a == b for a, b in zip(words, words[1:])) / n, marked / n, before, min(len(cuts), 20) / 20])
        before = different
    return out


def test_encoding_equals_word_by_word(odd):
    texts = {(r["text"] or "").encode() for r in odd.collect()} | {b" one two two, two! |x| (y) 12\x0b\x0c3 ", "Äpfel 漢字 a_b\n\nc".encode()}
    for text in texts:
        for passage in (3, 48):
            assert np.allclose(quality.encode(text, passage), plain_encode(text, passage), atol=1e-6)


def test_every_passage_takes_part_in_the_fit(spark):
    """What tells labels apart stands in one of 200 passages, at a place that thinning to 64 would often miss."""
    r = random.Random(2)
    rows = []
    for i in range(60):
        words = [r.choice("alpha beta gamma delta".split()) for _ in range(9600)]
        if i % 2:
            at = 48 * r.randrange(200)
            words[at:at + 48] = ["|||"] * 48
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(docs, docs.select("doc_id", "label"), quality.QualityRules(steps=200, batch=60))
    got = {x["doc_id"]: x["score"] for x in quality.scored(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i, _, _ in rows)


def test_passages_reach_the_end():
    text = ("word " * 1000 + "!!! ||| " * 50).encode()
    rows = quality.encode(text, 48)
    assert len(rows) == -(-1100 // 48) and rows[0, quality.KINDS.index("mark")] == 0 < rows[-1, quality.KINDS.index("mark")]
    assert quality.encode(b"", 48).shape == quality.encode(b" \n", 48).shape == (1, quality.FEATURES)
