"""Operators that give a row per document, against brute-force versions on tricky rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from webgleaner.llm import ans, backoff_lm, bucket_digest, factor_dedup, language_bloom, simhash
from webgleaner.llm.queries import QUERIES

from .conftest import prose


def remainder(doc_id, modulus):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- op2 ---


def covered_by_earlier(rows, length=50):
    order = lambda r: -(1 << 63) if r[0] is None else r[0]
    first = {}
    for r in rows:
        raw = (r[1] or "").encode()
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            first[w] = min(first.get(w, order(r)), order(r))
    out = []
    for r in rows:
        raw = (r[1] or "").encode()
        mask = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] < order(r):
                mask[s : s + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        out.append((r[0], len(raw), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_factors_match_brute_force(tricky, tricky_rows):
    assert sorted_rows(factor_dedup.factor_digest(tricky)) == covered_by_earlier(tricky_rows)


def test_factors_of_repetitive_texts_in_many_tasks(spark):
    rows = [(i, ("ab" * 40 + str(i % 7) + "the " * 60 + prose(i % 5, 30))[i:], None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(13)
    assert sorted_rows(factor_dedup.factor_digest(df)) == covered_by_earlier(rows)


def test_hot_anchors_are_split_without_change(spark, tricky, tricky_rows):
    hot = factor_dedup.factor_spans(tricky.repartition(8), hot=1)
    fields = [("n", factor_dedup.pa.int64(), "long"), ("removed", factor_dedup.pa.int64(), "long"), ("spans", factor_dedup.pa.int64(), "long"), ("sha", factor_dedup.pa.string(), "string")]
    assert sorted_rows(factor_dedup._with_documents(tricky, hot, factor_dedup.digest_of, fields)) == covered_by_earlier(tricky_rows)


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(factor_dedup, "PART", 1000)
    monkeypatch.setattr(factor_dedup, "CHUNK", 3000)
    rows = [(1, prose(1, 900), None), (2, prose(2, 300) + prose(1, 900) + "!", None), (3, prose(2, 200), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string")
    assert sorted_rows(factor_dedup.factor_digest(df)) == covered_by_earlier(rows)


def test_cut_texts(spark):
    shared = "a passage of well over fifty bytes that two documents have in common, word by word"
    df = spark.createDataFrame([(1, "one " + shared), (2, "two " + shared + " end")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in factor_dedup.without_earlier_passages(df).collect()}
    # The space before the passage is shared too.
    assert got == {1: "one " + shared, 2: "two end"}


def test_hits_come_by_place_not_by_document(spark, monkeypatch):
    counts = {}

    def counted(df, label, stage=factor_dedup.stage):
        out = stage(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(factor_dedup, "stage", counted)
    rows = [(i, prose(i, 20) + prose(1000, 60) + prose(1000 + i % 9, 40), None) for i in range(400)]
    got = sorted_rows(factor_dedup.factor_digest(spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(3)))
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got == covered_by_earlier(rows)
    assert 0 < counts["anchor-hits"] <= places * places


def test_suffixes_sorted_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(factor_dedup, "SUFFIXES", 10)
    rows = [(i, prose(i % 4, 30) + "aa" * 60 + prose(i % 3, 30), None) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string")
    assert sorted_rows(factor_dedup.factor_digest(df)) == covered_by_earlier(rows)


def test_previous_factors_with_hashes():
    rng = np.random.default_rng(4)
    strings = rng.integers(97, 99, (3000, 10)).astype(np.uint8)
    docs = rng.integers(0, 40, 3000)
    true = strings.astype(np.uint64) @ (np.uint64(1) << np.arange(10, dtype=np.uint64))
    wanted = factor_dedup.previous_factors(strings, docs)
    for hashes in (true, true % np.uint64(7)):  # the second: unlike rows with one hash
        assert (factor_dedup.previous_factors(strings, docs, hashes) == wanted).all()


def test_previous_factors_against_all_pairs():
    rng = np.random.default_rng(3)
    strings = rng.integers(97, 99, (300, 12)).astype(np.uint8)
    docs = rng.integers(0, 40, 300)
    got = factor_dedup.previous_factors(strings, docs)
    for i in range(300):
        best = 0
        for j in np.flatnonzero(docs < docs[i]):
            same = strings[i] == strings[j]
            best = max(best, 12 if same.all() else int(same.argmin()))
        assert got[i] == (best if best >= 6 else 0)


# --- op6 ---


def test_digests(tricky, tricky_rows):
    got = bucket_digest.fingerprint(tricky).collect()
    assert len(got) == len(tricky_rows)
    by_text = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    plain = [r for r in tricky_rows if r[0] is not None]
    ordered = sorted({r[0] for r in plain})
    texts = {}
    for r in tricky_rows:
        texts.setdefault(r[0], set()).add(r[1] or "")
    single = [d for d in ordered if len(texts[d]) == 1]
    for r in got:
        d = r["doc_id"]
        if d in single:
            (text,) = texts[d]
            assert r["n_chars"] == len(text)
            by_text.setdefault(text, set()).add(r["fingerprint"])
            after = ordered[ordered.index(d) + 1] if d != ordered[-1] else None
            if len(texts[after]) == 1 and sum(x[0] == d for x in tricky_rows) == 1:
                (following,) = texts[after]
                half = len(text) // 2
                edited = (text[: len(text) - half] + following[:half]).encode()
                assert r["edited_sha256"] == hashlib.sha256(edited).hexdigest()
                assert r["near_next"] == bucket_digest.compare_digests(r["fingerprint"], bucket_digest.as_text(*bucket_digest.digests([following.encode()]))[0])
                assert r["near_edited"] == bucket_digest.compare_digests(r["fingerprint"], r["edited_fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_digest_counts_all_triplets(monkeypatch):
    text = prose(1, 200).encode()
    whole = bucket_digest.bucket_counts([text, b"ab", b""])
    monkeypatch.setattr(bucket_digest, "CHUNK", 64)
    assert (bucket_digest.bucket_counts([text, b"ab", b""]) == whole).all()
    n = len(text)
    assert whole[0].sum() == (n - 2) + 2 * (n - 3) + 3 * (n - 4)
    assert whole[1].sum() == whole[2].sum() == 0


def test_single_document_follows_itself(spark):
    (row,) = bucket_digest.fingerprint(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and row["near_next"] == 1.0


# --- op8 ---


def simple_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(tricky, tricky_rows):
    prints = [(r[0], simple_fingerprint(r[1])) for r in tricky_rows]
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints):
            if (a ^ b).bit_count() <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    expected = []
    for i, (d, f) in enumerate(prints):
        ids = [prints[j][0] for j in range(len(prints)) if group[j] == group[i] and prints[j][0] is not None]
        expected.append((d, f"{f:016x}", min(ids) if ids else None))
    assert sorted_rows(simhash.simhash_groups(tricky)) == sorted(expected, key=repr)


def test_close_links_connect_all_within_the_radius(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    values = set()
    for c in centres:
        for _ in range(20):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            values.add(int(c) ^ sum(1 << int(b) for b in flips))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.close_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))
    roots = {r["id"]: r["root"] for r in simhash.components(links).collect()}
    group = {v: v for v in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    assert {v: roots.get(v, v) for v in signed} == group


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    values = [int(v) for v in rng.integers(0, 1 << 16, 400)]
    tree = simhash.BKTree(3)
    for i, v in enumerate(values):
        assert sorted(tree.near(v)) == [j for j in range(i) if (values[j] ^ v).bit_count() <= 3]
        tree.insert(v)


def test_near_copies(spark, monkeypatch):
    base = [prose(s, 150).split() for s in range(6)]
    rows, doc_id = [], 0
    for words in base:
        for copy in range(4):
            changed = list(words)
            if copy:
                changed[10 * copy] = "replaced"
            rows.append((doc_id, " ".join(changed), "x"))
            doc_id += 1
    rows += [(None, rows[0][1], "x"), (900, None, "x"), (901, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    kept = sorted_rows(simhash.without_near_copies(df).select("doc_id"))
    assert kept == [(0,), (12,), (16,), (20,), (4,), (8,), (900,), (None,)]
    # Split shards give the same groups.
    monkeypatch.setattr(simhash, "TREE_NODES", 2)
    assert sorted_rows(simhash.without_near_copies(df).select("doc_id")) == kept


def test_split_shards_lose_no_links(spark, monkeypatch):
    """Chains of texts, of which only neighbours are near: each shard whole or split, the groups are the same."""
    rows = []
    for chain in range(3):
        words = prose(500 + chain, 160).split()
        for step in range(12):
            rows.append((len(rows), " ".join(words)))
            words = words[12:] + prose(900 + 20 * chain + step, 12).split()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "TABLES", 1)
    monkeypatch.setattr(simhash, "KEY_BITS", 0)
    whole = sorted_rows(simhash.near_copy_groups(df))
    assert len({g for _, g in whole}) < len(rows) // 2
    monkeypatch.setattr(simhash, "TREE_NODES", 20)
    assert sorted_rows(simhash.near_copy_groups(df)) == whole


# --- op9 ---


def test_language_model(tricky, tricky_rows):
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [b"\n"]) for r in tricky_rows]
    counts = Counter()
    for d, words in tokens:
        if remainder(d, 5) != 1:
            counts.update(words)
    total, kinds = sum(counts.values()), len(counts)
    got = backoff_lm.lm_scores(tricky).collect()
    assert len(got) == len(tokens)
    expected = sorted(
        (repr(d), len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), 6))
        for d, w in tokens
    )
    assert expected == sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert all(r["score"] < 0 for r in got)


def test_probabilities_add_up_to_one(spark):
    """Every history: the known words and one unknown share all of the probability."""
    rows = [(i, prose(i % 9, 40)) for i in range(60)]
    words = Counter(w for _, t in rows for w in [*t.split(), "\n"])
    names = sorted(words, key=lambda w: (-words[w], w))
    number = {w: i for i, w in enumerate(names, 1)}
    ids = [[number[w] for w in t.split()] + [number["\n"]] for _, t in rows]
    end = number["\n"]
    pairs, triples = Counter(), Counter()
    for seq in ids:
        history = [end, *seq]
        pairs.update((a << 32) | b for a, b in zip(history, history[1:]))
    kept = np.array(sorted(k for k, n in pairs.items() if n >= 2))
    place = {int(k): i for i, k in enumerate(kept)}
    for seq in ids:
        history = [end, *seq]
        for a, b, c in zip(history, history[1:], history[2:]):
            if (a << 32) | b in place and (b << 32) | c in place:
                triples[(place[(a << 32) | b] << 32) | c] += 1
    kept3 = np.array(sorted(k for k, n in triples.items() if n >= 2))
    counts = np.array([words[w] for w in names])
    model = backoff_lm.Automaton(counts, int(counts.sum()), len(names), kept, np.array([pairs[int(k)] for k in kept]), kept3, np.array([triples[int(k)] for k in kept3]), end)
    unknown = math.log10(0.5 / (counts.sum() + 0.5 * (len(names) + 1)))
    for history in ([], ids[0][:1], ids[0][:2], ids[3][:5], [number[names[3]], number[names[5]]]):
        before = model.score(np.array(history, dtype=np.int64), np.array([len(history)]))[0] if history else 0.0
        mass = 0.0
        for w in range(len(names) + 1):
            after = model.score(np.array([*history, w], dtype=np.int64), np.array([len(history) + 1]))[0] + (unknown if w == 0 else 0)
            mass += 10 ** (after - before)
        assert abs(mass - 1) < 1e-9


def test_model_beats_the_base_on_repeated_text(spark):
    rows = [(i, prose(i % 3, 60)) for i in range(50)]
    got = backoff_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["score"] > r["base_score"] for r in got if r["held_out"])


def scores_by_hand(rows, least=2):
    """Interpolated absolute discounting over all n-grams seen at least ``least`` times."""
    tokens = [(d, ["\n", *(t or "").lower().split(), "\n"]) for d, t in rows]
    n = Counter()
    for d, w in tokens:
        if remainder(d, 5) != 1:
            n.update((x,) for x in w[1:])
            n.update(zip(w, w[1:]))
            n.update(zip(w, w[1:], w[2:]))
    total, kinds = sum(c for g, c in n.items() if len(g) == 1), sum(len(g) == 1 for g in n)
    taken = Counter()
    for g, c in n.items():
        if len(g) > 1 and c >= least:
            taken[g[:-1]] += c - backoff_lm.DISCOUNT

    def p(gram):
        if len(gram) == 1:
            return (n[gram] + 0.5) / (total + 0.5 * (kinds + 1))
        history = gram[:-1]
        if n[history] < least:
            return p(gram[1:])
        own = (n[gram] - backoff_lm.DISCOUNT) / n[history] if n[gram] >= least else 0.0
        return own + (1 - taken[history] / n[history]) * p(gram[1:])

    return [(d, sum(math.log10(p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(1, len(w)))) for d, w in tokens]


@pytest.mark.parametrize("chunk_tokens", [1, 90, 1 << 19])
def test_scores_against_brute_force(spark, monkeypatch, chunk_tokens):
    """However the texts are cut into chunks."""
    monkeypatch.setattr(backoff_lm, "CHUNK_TOKENS", chunk_tokens)
    rows = [(i, prose(i % 11, 30) + " " + prose(100 + i, 20)) for i in range(40)] + [(None, None), (7, ""), (8, "once only")]
    got = backoff_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = sorted((repr(d), round(s, 6)) for d, s in scores_by_hand(rows))
    assert sorted((repr(r["doc_id"]), round(r["score"], 6)) for r in got) == expected


def test_rare_n_grams_stay_in_a_large_corpus(spark):
    """A text seen three times is known by its n-grams, also beside millions of other words."""
    rows = [(i, "the of and to " * 25_000) for i in range(60)] + [(100 + i, prose(1, 60)) for i in range(4)]
    assert sum(len(t.split()) for d, t in rows if remainder(d, 5) != 1) > 4_000_000
    got = backoff_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert all(r["score"] > r["base_score"] + 60 for r in got if r["doc_id"] >= 100)


def test_frequent_words_are_dealt_to_several_buckets(spark, monkeypatch):
    """Words and pairs of words that are frequent in the corpus: their n-grams meet in several buckets, the scores are the same."""
    for name, value in (("CHUNK_TOKENS", 150), ("BUCKET_TOKENS", 60), ("LEAST_SPREAD", 1)):
        monkeypatch.setattr(backoff_lm, name, value)
    rows = [(i, " ".join(f"of the {w}" for w in prose(i % 7, 25).split()) + " the of " + prose(200 + i, 9)) for i in range(60)]
    hot = []
    number_words = backoff_lm.number_words
    monkeypatch.setattr(backoff_lm, "number_words", lambda buckets, most: hot.append((buckets, most)) or number_words(buckets, most))
    got = backoff_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    buckets, most = hot[0]
    assert min(buckets, 60 * 25 // most) >= 2 * backoff_lm.SHARE  # "of the" is a unit of its own, in several buckets
    expected = sorted((repr(d), round(s, 6)) for d, s in scores_by_hand(rows))
    assert sorted((repr(r["doc_id"]), round(r["score"], 6)) for r in got) == expected


def test_texts_of_chunks_are_not_shuffled(spark):
    """Chunks lie in buckets: only what they ask and are answered moves."""
    rows = [(i, prose(i % 9, 40)) for i in range(60)]
    got = backoff_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", part.strip())]
    assert moved and not any("doc_ids" in part for part in moved)


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], [255, 256, 70_000, 1 << 62], list(range(3000))])
def test_packed_numbers(values):
    arrays = [np.array(values, dtype=np.int64), np.array(values[::-1], dtype=np.int64)]
    assert [a.tolist() for a in backoff_lm.unpacked(backoff_lm.packed(*arrays))] == [values, values[::-1]]


# --- op10 ---


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_files(tricky, tricky_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in tricky_rows]
    kinds = [(d, len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for d, i in ids]
    got = ans.token_output(tricky, tokenizer_path()).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(kinds, key=repr)
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    order = [-(1 << 63) if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)


def test_counting_ids_lets_the_tokenizer_go():
    import pyarrow as pa

    from webgleaner.llm.common import worker_store

    worker_store()["tokenizer"] = "pieces"
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])
    ids = pa.RecordBatch.from_pydict({"ids": [np.array([3, 3, 5], "<u2").tobytes()]})
    assert [b.to_pydict() for b in ans.count_ids("<u2", schema)([ids])] == [{"id": [3, 5], "n": [2, 1]}]
    assert not worker_store()


@pytest.mark.parametrize("text", ["don't we'll 's 'struth", "a,.b -- c!!", "x<|endoftext|>y", "ÀÉ ßŒ œ Σας ﬁ é", "1½ ² 3rd", "a b c\x85d\x1ce", "ªº µ ÷×", "İİ"])
def test_pieces_are_the_tokenizers_own(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    with open(tokenizer_path(), encoding="utf-8") as file:
        encode = ans.encoder(file.read(), "<u2")
    assert np.frombuffer(encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_unknown_latin_pieces_skip_the_tokenizers_own_steps():
    from tokenizers import Tokenizer

    class ModelOnly:
        model = Tokenizer.from_file(tokenizer_path()).model

    text = "Qwzrtô don't 1½ naïve-ly \x00\x1c\x7f µ"
    pieces = ans.ModelPieces(ModelOnly, "<u2")
    got = b"".join(map(pieces.__getitem__, ans.PIECE.findall(text.lower())))
    assert np.frombuffer(got, "<u2").tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_blocks_round_trip_and_damage_is_seen():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 300_000), 5000)
    table = ans.Frequencies(*np.unique(ids, return_counts=True))
    assert int(table.freq.sum()) == 1 << table.bits
    data = ans.file_bytes([7, None], [200_000, 100_000], ids, table)
    assert len(data) < len(ids) * 1.3
    doc_ids, sizes, points = ans.read_file(data, table)
    assert doc_ids == [7, None] and sizes.tolist() == [200_000, 100_000] and len(points) == 2
    # Blocks are independent: the last can be read alone.
    assert (ans.read_block(data, points[1], table) == ids[points[1][0] :]).all()
    assert (np.concatenate([ans.read_block(data, p, table) for p in points]) == ids).all()
    damaged = bytearray(data)
    damaged[points[1][-1] + 9000] ^= 1
    with pytest.raises(ValueError):
        ans.read_block(bytes(damaged), points[1], table)
    damaged = bytearray(data)
    damaged[20] ^= 1
    with pytest.raises(ValueError):
        ans.read_file(bytes(damaged), table)


def test_one_kind_of_id():
    ids = np.full(3000, 5)
    table = ans.Frequencies(np.array([5]), np.array([3000]))
    assert (ans.decode_block(ans.encode_block(ids, table), 3000, table) == 5).all()


# --- op5 ---


def test_languages(tricky, tricky_rows):
    got = language_bloom.identify(tricky).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in tricky_rows)
    texts = {r[0]: r[1] for r in tricky_rows}
    known = {r[2] for r in tricky_rows if r[2] is not None and r[1] and remainder(r[0], 3) != 1}
    for r in got:
        assert r["held_out"] == (remainder(r["doc_id"], 3) == 1)
        text = texts[r["doc_id"]]
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert r["lang_pred"] in known | {"und"} and 0 <= r["score"] <= 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in language_bloom.identify(docs).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.97


def test_filter_has_no_false_negatives_and_a_known_false_rate():
    rng = np.random.default_rng(4)
    keys = language_bloom.mixed(np.arange(1, 40_001, dtype=np.uint64))
    langs = rng.integers(0, 70, len(keys))
    sliced = language_bloom.SlicedFilter(keys, langs, 70)
    masks = sliced.lookup(keys)
    for lang in range(70):
        assert sliced.bit(masks[langs == lang], lang).all()
    others = language_bloom.mixed(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64))
    found = np.array([sliced.bit(sliced.lookup(others), lang).mean() for lang in range(70)])
    assert np.allclose(found, sliced.false_rate, atol=0.004)


# --- all ---


@pytest.mark.parametrize(
    "work",
    [
        factor_dedup.factor_digest, factor_dedup.without_earlier_passages, language_bloom.identify, bucket_digest.fingerprint,
        simhash.simhash_groups, simhash.without_near_copies, backoff_lm.lm_scores, lambda d: ans.token_output(d, tokenizer_path()),
    ],
)
def test_empty_table(empty, work):
    assert work(empty).collect() == []


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
