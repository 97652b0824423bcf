import random

import pytest
from tokenizers import Tokenizer, models, normalizers

from waymark.llm import queries, tokens

ALPHABET = "ab c▁dé漢\n<"


def tokenizer(vocabulary, fallback):
    t = Tokenizer(models.Unigram(list(vocabulary.pieces), unk_id=0, byte_fallback=fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids) if text else 0


@pytest.mark.parametrize("seed", range(8))
def test_small_vocabularies_with_ties(seed):
    rng = random.Random(seed)
    pieces = {"<unk>": 0.0}
    for _ in range(25):
        piece = "".join(rng.choice(ALPHABET.replace("\n", "")) for _ in range(rng.randrange(1, 4))).replace(" ", "▁")
        pieces[piece] = float(-rng.randrange(1, 6)) if seed % 2 else -rng.random() * 5
    if seed % 4 < 2:
        pieces |= {f"<0x{b:02X}>": -3.0 for b in range(256)}
    vocabulary = tokens.Vocabulary(tuple(pieces.items()))
    want, counter = tokenizer(vocabulary, vocabulary.bytes_known), tokens.Counter(vocabulary, cache=5)
    for _ in range(300):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 40)))
        assert counter.count(text) == want(text), repr(text)


def test_public_vocabulary_on_odd_texts(spark, odd, nothing):
    vocabulary = tokens.read_vocabulary(queries.vocabulary_path())
    assert vocabulary.parts_alone and vocabulary.bytes_known
    want = tokenizer(vocabulary, True)
    got = tokens.token_counts(odd, vocabulary).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted((r["doc_id"] or -1, want(r["text"] or "")) for r in odd.collect())
    assert tokens.token_counts(nothing, vocabulary).count() == 0


def test_query_of_the_whole_table(spark):
    want = tokenizer(tokens.read_vocabulary(queries.vocabulary_path()), True)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op5_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: want(t) for i, t in texts.items()}
