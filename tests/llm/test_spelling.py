"""Spelling variants against a brute-force version."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from webgleaner.llm import spelling
from webgleaner.llm.queries import QUERIES

from .conftest import prose


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def random_words(seed, n, letters="abÀé", sizes=(7, 8, 9, 12)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))): rng.choice([2, 3, 20, 35, 200, 3000]) for _ in range(n)}


@pytest.mark.parametrize("most", [2000, 3])
def test_near_words_match_brute_force(spark, most):
    words = random_words(1, 700) | random_words(2, 40, "xyz", (7, 30, 31)) | {"z" * n: n for n in range(7, 60)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    got = {r["word"]: (r["n_near"], r["near"], r["near_n"]) for r in spelling.near_words(df, most).collect()}
    want = {}
    for a in words:
        near = [b for b in words if one_edit(a, b)]
        if near:
            best = min(near, key=lambda x: (-words[x], x))
            want[a] = (len(near), best, words[best])
    assert got == want


def test_hot_block_is_divided_and_every_pair_found_once(spark):
    rng = random.Random(5)
    words = {"commonprefix" + "".join(rng.choice("ab") for _ in range(rng.choice([9, 10]))): 2 for _ in range(500)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.choice([9, 10]))) + "commonending": 2 for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    sizes = spelling.blocks(df, 20).groupBy("key").count()
    # What cannot be divided leaves one letter open.
    assert sizes.agg({"count": "max"}).first()[0] <= 20
    got = {r["word"]: r["n_near"] for r in spelling.near_words(df, 20).collect()}
    assert got == {a: n for a in words if (n := sum(one_edit(a, b) for b in words))}


def test_documents_match_brute_force(spark):
    rng = random.Random(3)
    base = ["morning", "gardens", "silvery", "straße", "übersicht", "Reasons", "mornings", "distante"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice(["", "", ", ", "x", "1"]) for _ in range(200))) for i in range(80)]
    rows += [(None, "morning gardens " * 5), (3, None), (4, ""), (5, "a" * 30_000 + " " + "a" * 29_999), (6, "a" * 30_000), (7, "a" * 29_999)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling.spelling_groups(df)) == brute(brute_words(rows))


def test_chain_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(11)]
    got = dict(tuple(r) for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert got == {f"w{i}": "w11" for i in range(11)}


def test_tricky_rows(tricky, tricky_rows, empty):
    assert found(spelling.spelling_groups(tricky)) == brute(brute_words([r[:2] for r in tricky_rows]))
    assert found(spelling.spelling_groups(empty)) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = QUERIES["op12_spelling_variants"](spark, sf)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(df) == brute(dict(sorted(brute_words(rows).items())))
