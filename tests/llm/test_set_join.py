"""Near copies are all pairs of a Jaccard similarity of 0.8 or more, compared with all pairs of small tables."""

import random

import pytest

from webgleaner.llm import set_join, simhash

from .conftest import prose


def shingles(text, width=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def changed(text, rng, places):
    words = text.split()
    for at in rng.sample(range(len(words)), places):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def texts():
    """Pairs around the threshold of short and long texts, texts that share passages, families, repeated bodies."""
    rng, out = random.Random(11), []
    for seed in range(90):
        base = prose(1000 + seed, (6, 12, 40, 150, 151, 400)[seed % 6])
        size = len(base.split())
        out += [base, changed(base, rng, max(1, rng.randrange(size // 60 + 1, size // 40 + 2)))]
    passage = prose(77, 60)
    out += [f"{passage} {prose(2000 + n, 12 + n % 9)}" for n in range(30)]
    family = prose(78, 200)
    out += [changed(family, rng, rng.randrange(1, 5)) for _ in range(40)]
    body = prose(79, 80)
    out += [body, f"{body} {body} {body}"]
    return out


@pytest.mark.parametrize(("members", "rounds"), [(1 << 19, set_join.ROUNDS), (500, (None,))])
def test_all_near_pairs_are_in_one_group(spark, monkeypatch, members, rounds):
    monkeypatch.setattr(simhash, "CHUNK_MEMBERS", members)
    monkeypatch.setattr(set_join, "ROUNDS", rounds)
    rows = list(enumerate(texts()))
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert sum(jaccard(sets[i], sets[j]) < 0.85 for i, j in pairs) > 20
    found = dict(simhash.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(i, j) for i, j in pairs if found[i] != found[j]] == []
    # Nothing else meets: groups are those of all pairs, besides what the fingerprints alone find near.
    for i, j in found.items():
        assert i == j or any(jaccard(sets[i], sets[k]) >= 0.6 for k in found if k != i)


def test_groups_without_fingerprint_links_are_those_of_all_pairs(spark, monkeypatch):
    """With no help of the fingerprints the groups are exactly the components of all near pairs."""
    monkeypatch.setattr(simhash, "wide_value_links", lambda values, *_: values.selectExpr("id AS a", "id AS b"))
    rows = list(enumerate(texts()))
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    found = dict(simhash.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [found[i] for i in range(len(rows))] == group
