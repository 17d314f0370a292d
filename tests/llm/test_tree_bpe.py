"""Tree concatenation against the tokenizer's own encoding of whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webgleaner.llm import tree_bpe
from webgleaner.llm.queries import QUERIES

from .conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "don't", "'", "'s", "''ll", "!!", "that", "THE", "  ", "\n", "é", "é", "ﬁ", "東京", "가각", "각", "क्षि", "\U0001f600", "\U0001f468‍\U0001f469", "123", "²", "<|endoftext|>",
    "<|startoftext|>", "<|endof", "text|>", "ß", "İ", "ÀÉ", "\x00", "\x1c", "\xa0", "ạ̈́", "aaaa", "haha", "======", ".", ",", "the", "ing", "Σς", "́́",
]


@pytest.fixture(scope="module")
def coder():
    with open(PATH, encoding="utf-8") as file:
        return tree_bpe.Codec(file.read())


def digest(tokenizer, doc_id, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def brute(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return sorted((digest(tokenizer, *row) for row in rows), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(60))
def test_small_leaves_and_windows(coder, seed):
    """Leaves of a few characters and windows of one put every kind of border at a join."""
    rng = random.Random(seed)
    for _ in range(25):
        chosen = rng.sample(PARTS, rng.choice([1, 2, 3, 8, len(PARTS)]))
        text = "".join(rng.choice(chosen) for _ in range(rng.choice([5, 40, 150])))
        leaf, window = rng.choice([1, 2, 3, 5, 17]), rng.choice([1, 2, 3, 8])
        assert tree_bpe.encode_long(coder, text, leaf, window) == coder.encode(text), (text, leaf, window)


@pytest.mark.parametrize("letters", ["a", "ab", "the", "aehinorst", "!=", "é東", "lo'", "0", "haHA"])
def test_long_texts_without_white_space(coder, letters):
    for seed in range(6):
        rng = random.Random(seed)
        text = "".join(rng.choice(letters) for _ in range(3000))
        assert tree_bpe.encode_long(coder, text, 100, 4) == coder.encode(text)


def test_words_apart_give_the_same_digests(coder):
    rng = random.Random(9)
    texts = ["".join(rng.choice([*PARTS, *(chr(rng.randrange(32, 0x3000)) for _ in range(9))]) for _ in range(rng.choice([0, 3, 40]))) for _ in range(4000)]
    assert coder.words.digests([None, *texts]) == [digest(coder.tokenizer, None, t)[1:] for t in ["", *texts]]


def test_cuts():
    text = "x" * 1000
    edges = [0, *tree_bpe.cuts(text, 100), 1000]
    assert edges == sorted(set(edges)) and max(b - a for a, b in zip(edges, edges[1:])) <= 100
    # Nothing is cut before a mark that may combine.
    assert tree_bpe.cuts("a" + "́" * 500, 10) == []
    assert all(text[at] != "́" for text in ["á" * 300] for at in tree_bpe.cuts(text, 10))


def test_rows_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 5, 300, 900])))) for i in range(60)]
    rows += [(1, rows[1][1]), (None, "z" * 5000), (None, None), (3, ""), (4, prose(1, 3000)), (5, "the" * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for leaf in (50, 16_384):
        assert found(tree_bpe.encode_digests(df, PATH, leaf, 3)) == brute(rows)


def test_tricky_rows(tricky, tricky_rows, empty):
    assert found(tree_bpe.encode_digests(tricky, PATH)) == brute([r[:2] for r in tricky_rows])
    assert found(tree_bpe.encode_digests(empty, PATH)) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    df = QUERIES["op13_tree_bpe"](spark, sf)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert found(df) == brute([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
