"""Aligned tokens against a brute-force version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from webgleaner.llm import alignment
from webgleaner.llm.queries import QUERIES

from .conftest import prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a  b", " lead", "trail ", "\n\n x \t y", "x y z", "tab\tx \x1c y", "▁ under", "don't 's x's 'll", "<|endoftext|> <s> </s> <0x41> <unk>",
    "東京タワー は 高い", "\U0001f600\U0001f600 \U0001f468‍\U0001f469", "==== ==== =====", "a" * 3000, "á é ﬁ ①", " ", "  ", "\n", "\x00 x\x00y z", "Ünï 12 345,6",
]


def brute(rows):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()
    names = {i: t for t, i in tokenizer.get_vocab().items()}
    made, docs = [], defaultdict(int)
    for doc_id, text in rows:
        a = b = groups = None
        if text:
            a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            bytes_a = [bytes(letters[c] for c in names[i]) for i in a]
            bytes_b = [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = []
                for tokens in (bytes_a, bytes_b):
                    at, places = 0, []
                    for t in tokens:
                        at += len(t)
                        places.append(at)
                    ends.append(places)
                common = sorted(set(ends[0]) & set(ends[1]))
                groups, low = [], 0
                for end in common:
                    groups.append(([i for i, e in zip(a, ends[0]) if low < e <= end], [i for i, e in zip(b, ends[1]) if low < e <= end]))
                    low = end
        made.append((doc_id, a, b, groups))
        for pair in {(x, y) for ga, gb in groups or [] for x in ga for y in gb}:
            docs[pair] += 1
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, a, b, groups in made:
        if not groups:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [docs[x, y] for ga, gb in groups for x in ga for y in gb]
        best = sum(docs[x, y] == most[x] for ga, gb in groups for x in ga for y in gb)
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(20))
def test_common_ends(seed):
    rng = random.Random(seed)
    lists = [[sorted(rng.sample(range(400), rng.choice([0, 1, 5, 60, 300]))) for _ in range(2)] for _ in range(7)]
    sizes = [np.array([len(pair[k]) for pair in lists]) for k in range(2)]
    a, b = (np.array([x for pair in lists for x in pair[k]], dtype=np.int64) for k in range(2))
    places = alignment.common_ends(a, sizes[0], b, sizes[1])
    assert (a[places[0]] == b[places[1]]).all()
    assert a[places[0]].tolist() == [x for one, other in lists for x in sorted(set(one) & set(other))]


def test_encoder_by_ranks_gives_the_same_ids():
    with open(A, encoding="utf-8") as file, open(B, "rb") as model:
        align = alignment.Aligner(file.read(), model.read())
    rng = random.Random(4)
    for _ in range(20_000):
        letters = rng.choice([[chr(i) for i in range(256)], "abcdefghijklmnopqrstuvwxyzé ,.'\n\xa0\x85", " \n\t'sStTlLrRmMdD1\xa0²"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
        assert align.quick.encode_ordinary(text) == align.a.encode(text, add_special_tokens=False).ids


def test_large_groups_by_distinct_ids(spark, monkeypatch):
    rows = [(i, "".join(random.Random(i).choice("ab東é.'1") for _ in range(60))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    assert found(alignment.token_links(df, A, B)) == want


@pytest.mark.parametrize("most_parts", [1 << 21, 40])
def test_odd_texts_match_brute_force(spark, monkeypatch, most_parts):
    monkeypatch.setattr(alignment, "KEEP_PARTS", most_parts)
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, rng.choice(["", " ", "\n"]).join(rng.choice(ODD) for _ in range(4))) for i in range(60)]
    rows += [(200 + i, "".join(rng.choice("ab 'sé\n.1東 ") for _ in range(40))) for i in range(100)] + [(None, "x y"), (7, None), (8, ""), (9, prose(1, 60)), (9, prose(1, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(alignment.token_links(df, A, B, most_parts)) == brute(rows)


def test_tricky_rows(tricky, tricky_rows, empty):
    rows = [r[:2] for r in tricky_rows if not r[1] or len(r[1]) < 20_000]
    short = tricky.where("text is null or char_length(text) < 20000")
    assert found(alignment.token_links(short, A, B)) == brute(rows)
    assert alignment.token_links(tricky, A, B).count() == len(tricky_rows)
    assert found(alignment.token_links(empty, A, B)) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    df = QUERIES["op11_token_alignment"](spark, sf)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = Counter(r[0] for r in rows)
    assert Counter(r["doc_id"] for r in df.collect()) == counts
    small = [r for r in rows if r[1] and len(r[1]) < 3000][:60]
    assert found(alignment.token_links(spark.createDataFrame(small, "doc_id long, text string"), A, B)) == brute(small)


def test_plain_texts_are_split_without_the_pattern(monkeypatch):
    want = {t: alignment.PART.split(t) for t in [*ODD, "a b", "a  b", " a b", "a b ", "a\n b", "a \u2003b", "a\nb c", "\n", " "] if t}
    assert {t: alignment.parts_of(t) for t in want} == want
    monkeypatch.setattr(alignment, "PART", None)
    assert alignment.parts_of("It's one\ntext, of parts") == ["It's", "one\ntext,", "of", "parts"]
