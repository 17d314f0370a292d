"""Operators that join several tables, the SQL counterparts and the pipeline."""

import math
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from webgleaner.llm import deobfuscate, mixing, templates, url_reputation
from webgleaner.llm.oracles import ORACLES
from webgleaner.llm.queries import QUERIES, URL_RULES

from .conftest import prose

SF = "/root/testdata/sf0.001"


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert [d[0] for d in cursor.description] == df.columns
    rounded = lambda rows: sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    assert rounded(tuple(r) for r in df.collect()) == rounded(cursor.fetchall())


# --- op1 ---


@pytest.fixture(scope="module")
def pages(spark):
    urls = [
        "http://WWW.Example.com/en/1?x", "https://a.example.com/en/", "https://example.com", "https://example.com/fr#x", "http://x.net/es/2",
        "http://net/es/", "http://x.net:80/es/", "no scheme", None, "", "://", "http:///p", "https://u@h.co.uk:8080/p?q", "http://10.0.0.1/x",
        "http://a.example.com/en/?://z/en/", "http://a.example.com/en/", "http://É.com/en/",
    ]
    rows = [(i, u, "x", "x") for i, u in enumerate(urls)]
    rows += [(None, "http://x.net/fr/1", "x", "x"), (3, urls[3], "x", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rules string")


def judged_by_hand(url):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].translate(lower), rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fitting = [
        (len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, max(fitting)[1:] if fitting else (None, None)


def test_urls_and_rules(spark, pages):
    outcomes = spark.createDataFrame([], "page_id long, bad boolean")
    got = url_reputation.judge_urls(pages, outcomes, URL_RULES).collect()
    assert len(got) == pages.count()
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    for r in got:
        host, path, (rule, verdict) = judged_by_hand(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_reputation_shrinks_towards_the_parents(spark):
    rows, bad, n = [], [], 0

    def add(host, count, bad_count):
        nonlocal n
        for i in range(count):
            rows.append((n, host))
            bad.append((n, i < bad_count))
            n += 1

    for i in range(12):
        add(f"a{i}.bad.org", 30, 28)
        add(f"a{i}.good.org", 30, 1)
        add(f"www.site{i}.net", 20, 3)
    add("new.bad.org", 1, 0)
    add("new.good.org", 1, 1)
    rows.append((n, "unseen.bad.org"))
    got = {
        r["host"]: r
        for r in url_reputation.host_reputation(
            spark.createDataFrame(rows, "page_id long, host string"), spark.createDataFrame(bad, "page_id long, bad boolean")
        ).collect()
    }
    assert got["new.bad.org"]["domain"] == "bad.org" and got["new.bad.org"]["suffix"] == "org"
    assert got["a1.bad.org"]["blocked"] and not got["a1.good.org"]["blocked"] and not got["www.site1.net"]["blocked"]
    # One label hardly moves a host away from its domain; no label not at all.
    assert got["new.bad.org"]["bad_rate"] > 0.5 > got["new.good.org"]["bad_rate"]
    assert got["unseen.bad.org"]["n_labelled"] == 0 and got["unseen.bad.org"]["bad_rate"] > 0.8
    assert got["a1.bad.org"]["bad_low"] < got["a1.bad.org"]["bad_rate"]


def test_outcomes(labels):
    assert sorted_rows(url_reputation.outcomes_from_labels(labels)) == [(0, False), (1, True), (7, True), (9, False)]


def test_no_pages(spark, pages, labels):
    assert url_reputation.judge_urls(pages.limit(0), url_reputation.outcomes_from_labels(labels), URL_RULES).collect() == []


# --- op3 ---


@pytest.fixture(scope="module")
def decoder():
    text = " ".join(prose(i, 300) for i in range(20)) + " stupid idiot moron" * 20
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
    (batch,) = deobfuscate.count_trigrams(schema)([pa.RecordBatch.from_pydict({"text": [text, None, ""]})])
    n = np.zeros(deobfuscate.SIZE**3)
    n[batch["gram"].to_numpy()] = batch["n"].to_numpy()
    n = n.reshape([deobfuscate.SIZE] * 3) + 0.01
    return deobfuscate.Decoder(np.log(n / n.sum(axis=2, keepdims=True)))


@pytest.mark.parametrize(
    ("written", "meant"),
    [("1d10t", "idiot"), ("stuuupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("i d i o t", "idiot"), ("yel-l0w", "yellow")],
)
def test_disguised_words(decoder, written, meant):
    assert meant in decoder.decode(written)


def test_a_token_without_edges_is_decoded_once(decoder, monkeypatch):
    seen, decode = [], deobfuscate.Decoder.decode
    monkeypatch.setattr(deobfuscate.Decoder, "decode", lambda self, text: [seen.append(text), decode(self, text)][1])
    restorer = deobfuscate.Restorer(decoder)
    assert "stupid" in restorer["stup1d"] and "stupid" in restorer["(stup1d)"] and restorer["stone"] == ("stone",)
    assert seen == ["stup1d", "stup1d", "(stup1d)"]


@pytest.mark.parametrize(
    ("written", "meant"),
    [("a stuupid man", "stupid"), ("an idiiot", "idiot"), ("mooron", "moron"), ("i  d \t i\n o  t", "idiot"), ("so i. d. i. o. t. it is", "idiot"), ("* i d i o t *", "idiot"), ("yellow", "yellow")],
)
def test_doubled_and_spaced_letters_are_decoded(decoder, written, meant):
    restorer = deobfuscate.Restorer(decoder)
    assert meant in deobfuscate.restored_words(written, restorer)
    scores = deobfuscate.WordScores(restorer, {meant + " ": 0.9})
    assert deobfuscate.text_score(written, scores, 0.0) > 0.8


def test_viterbi_finds_the_best_reading(decoder, monkeypatch):
    """Against all readings of a short lattice."""
    from itertools import product

    monkeypatch.setattr(deobfuscate, "BEAM", 10**6)
    for text in ("1d1", "aa.b", "$t0", "5 5s"):
        best = (-math.inf, None)
        for arcs in product(*(decoder.arcs(text, i) for i in range(len(text)))):
            a = b = 0
            total, letters = 0.0, []
            for symbol, cost in arcs:
                total += cost
                if symbol < 0 or (symbol == 0 and b == 0):
                    continue
                total += decoder.model[a][b][symbol]
                a, b = b, symbol
                letters.append(deobfuscate.ALPHABET[symbol])
            total += decoder.model[a][b][0] if b else 0.0
            best = max(best, (total, "".join(letters)))
        assert decoder.decode(text) == [w for w in best[1].split("\0") if w]


@pytest.fixture(scope="module")
def toxic_rows():
    rows, marks = [], []
    for i in range(300):
        bad = i % 4 == 0
        words = prose(i, 60).split()
        if bad:
            words[7] = words[31] = ["idiot", "1d10t", "i.d.i.o.t", "IDIOT!!", "idiiiot"][i // 4 % 5]
        rows.append((i, " ".join(words), "x"))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity(spark, toxic_rows, tricky, labels):
    rows, marks = toxic_rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    known = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in deobfuscate.score_toxicity(docs, known).collect()}
    truth = {d: t for d, _, t in marks}
    assert all(r["predicted"] == truth[d] for d, r in got.items())
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    kept = deobfuscate.without_toxic(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, t in truth.items() if not t}
    # Tricky rows and few or no labels: nothing is a sign.
    for some in (labels, labels.limit(0)):
        out = deobfuscate.score_toxicity(tricky, some).collect()
        assert len(out) == tricky.count() and not any(r["predicted"] for r in out)
    assert sorted_rows(deobfuscate.without_toxic(tricky, labels).select("doc_id", "text")) == sorted_rows(tricky.select("doc_id", "text"))
    assert deobfuscate.score_toxicity(tricky.limit(0), known).collect() == []


def test_labels_do_not_leak(spark, toxic_rows):
    """Held-out labels change nothing."""
    rows, marks = toxic_rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    held = {r["doc_id"] for r in deobfuscate.score_toxicity(docs, spark.createDataFrame(marks, "doc_id long, q int, toxic int")).where("held_out").collect()}
    flipped = [(d, q, 1 - t if d in held else t) for d, q, t in marks]
    first, second = (
        sorted_rows(deobfuscate.score_toxicity(docs, spark.createDataFrame(m, "doc_id long, q int, toxic int"))) for m in (marks, flipped)
    )
    assert held and first == second


# --- op4 ---


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, left = {}, dict(weight)
    while True:
        room = sum(sizes.values()) - sum(capped.values())
        over = {s for s, w in left.items() if room * w / sum(left.values()) >= most * sizes[s]}
        if not over:
            break
        capped |= {s: most * sizes[s] for s in over}
        left = {s: w for s, w in left.items() if s not in over}
        if not left:
            break
    room = sum(sizes.values()) - sum(capped.values())
    return capped | {s: room * w / sum(left.values()) for s, w in left.items()}


@pytest.mark.parametrize("bucket_rows", [3, 20_000])
def test_mix(tricky, tricky_rows, labels, bucket_rows):
    got = mixing.mix(tricky, labels, bucket_rows=bucket_rows).collect()
    sizes = Counter()
    for r in tricky_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    by_hand = targets_by_hand(dict(sizes))
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted((repr(r[0]), len((r[1] or "").encode().split())) for r in tricky_rows)
    assert Counter(r["source_size"] for r in got) == Counter(sizes[r[3]] for r in tricky_rows)
    assert all(any(abs(r["target"] - t) < 1e-6 for t in by_hand.values()) for r in got)
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_buckets_do_not_change_the_mix(spark):
    rows = [(i, prose(i, 1 + i % 50), f"s{i % 7 if i % 3 else 0}", "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    first, second = (sorted_rows(mixing.mix(docs, None, bucket_rows=b)) for b in (5, 10_000))
    assert first == second
    by_source = {}
    for d, size, source_size, target, taken, copies in first:
        by_source.setdefault(rows[d][2], [target, 0])[1] += taken
        assert copies >= int(target // source_size)
    assert all(abs(target - taken) <= 25 for target, taken in by_source.values())


def test_heavier_documents_come_first(spark):
    rows = [(i, "one two three", "a") for i in range(400)] + [(1000 + i, "word " * 600, "b") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = mixing.mix(docs, labels, weights=(1.0, 8.0)).where("size = 3").collect()
    taken = Counter(r["doc_id"] % 2 for r in got if r["taken"])
    assert taken[1] > 1.8 * taken[0]


def test_mixed_documents(tricky, labels, empty):
    columns = tricky.columns
    out = mixing.mixed_documents(tricky, labels)
    assert out.columns == columns
    copies = {r["doc_id"]: max(0, r["copies"]) for r in mixing.mix(tricky, labels).orderBy("copies").collect()}
    inputs, outputs = Counter(repr(r["doc_id"]) for r in tricky.collect()), Counter(repr(r["doc_id"]) for r in out.collect())
    assert outputs == Counter({d: n * copies[None if d == "None" else int(d)] for d, n in inputs.items()}) - Counter()
    assert mixing.mixed_documents(empty, labels).collect() == [] and mixing.mix(empty, labels).collect() == []


# --- op7 ---

QUESTION = "A farmer near Maria owns 12 sheep and sells them for 30 dollars each, so how much does Maria earn from 12 sheep"


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, QUESTION), (2, prose(100, 30)), (3, "tiny item here"), (4, None), (None, prose(101, 30)), (5, ""), (6, "the river under stone ladder")]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, window string")


def found(docs, benchmark, **options):
    return {(r["doc_id"], r["item_id"]): r for r in templates.template_matches(docs, benchmark, **options).collect()}


def test_windows_of_documents_are_not_searched_for_placeholders(spark, monkeypatch):
    asked, remove = [], templates.F.array_remove
    monkeypatch.setattr(templates.F, "array_remove", lambda column, mark: [asked.append(mark), remove(column, mark)][1])
    items = spark.createDataFrame([(1, "12 34 56 78 90 11 22 33 44"), (2, "at twelve kg of 7 days each the nine men went")], "item_id long, text string")
    docs = [(1, "so 12 34 56 78 90 11 22 33 44 it"), (2, "99 34 56 78 90 11 22 33 44"), (3, "7 34 56 78 90 11 22 33 45"), (4, "at 3 kg of 5 days each the nine men went")]
    rows = templates.template_matches(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 2, 9, 0), (2, 1, 1, 8, 0), (4, 2, 3, 5, 2)]
    # Only for the windows of the items, of one size here.
    assert asked == ["#", "@", "~"]


def test_templates(spark, benchmark):
    changed = QUESTION.replace("Maria", "Peter").replace("12", "45").replace("30 dollars", "7 euros")
    inconsistent = "A farmer near Anna owns 12 sheep and sells them for 30 dollars each, so how much does Peter earn from 99 sheep"
    rows = [
        (1, prose(1, 40) + " " + QUESTION + " " + prose(2, 40)),
        (2, prose(3, 40) + " " + changed),
        (3, inconsistent),
        (4, " ".join(QUESTION.split()[3:14])),
        (5, " ".join(prose(100, 30).upper().split()[5:20])),
        (6, prose(102, 5000)),
        (7, "1 2 3 4 5 6 7 8 9 10 11 12"),
        (8, None),
        (9, ""),
        (None, prose(101, 30)),
        (1, prose(1, 40) + " " + QUESTION + " " + prose(2, 40)),
        (10, "x the river under stone ladder y"),
        (11, QUESTION.replace(" ", "\n").replace("farmer", "farmer,")),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _valued string").repartition(5)
    got = found(docs, benchmark)
    assert set(got) == {(1, 1), (2, 1), (4, 1), (5, 2), (None, None), (10, 6), (11, 1)}
    assert got[1, 1]["n_changed"] == 0 and got[1, 1]["n_slots"] == 4
    assert got[2, 1]["n_changed"] == 4
    kept = templates.without_benchmark(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == ["3", "6", "7", "8", "9", "None"]


def test_templates_of_tricky_and_empty_tables(tricky, empty, benchmark):
    assert found(empty, benchmark) == {} and found(tricky, benchmark.limit(0)) == {}
    items = tricky.selectExpr("doc_id as item_id", "text")
    got = found(tricky, items)
    assert {(d, d) for d in (0, 1, 7, 8, -5)} <= set(got)
    assert templates.without_benchmark(tricky, benchmark.limit(0)).count() == tricky.count()


def test_short_and_slot_dense_items(spark):
    """Few plain words: equal values match, others do not; number words of any form are placeholders."""
    items = [(1, "Convert 5 km to miles"), (2, "What is 12"), (3, "He paid 3 4 5 6 7 8 dollars"), (4, "Maria has fifteen apples and gives twenty five away today"), (5, " .")]
    docs = [
        (1, "stone. Convert 5 km to miles now"),
        (2, "stone. Convert 6 km to miles now"),
        (3, "river. What is 12 then"),
        (4, "river. What is 13 then"),
        (5, "garden. He paid 3 4 5 6 7 8 dollars for it"),
        (6, "Maria has Sixty apples and gives ninety one away today"),
        (7, " ."),
        (8, ""),
    ]
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert set(got) == {(1, 1), (3, 2), (5, 3), (6, 4)}
    assert got[6, 4]["n_changed"] == 3 and got[1, 1]["n_changed"] == 0


# --- pipeline ---


def test_pipeline_against_plain_versions(spark, tmp_path):
    """Planted cases go, clean documents stay, and the output agrees with the tokenizer."""
    import zlib

    from tokenizers import Tokenizer

    import public_tokenizers

    rows, marks = [], []
    for i in range(400):
        text = prose(1000 + i, 150)
        if i % 8 == 0:
            text = text.replace("river", "idiot", 2) + (" 1d10t" if i % 16 else " idiot")
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        marks.append((i, 1, int(i % 8 == 0)))
    question = prose(77, 40)
    rows += [(1000 + i, rows[i + 1][1], "en", "s1", 1) for i in range(5)]
    rows += [(1010 + i, rows[i + 9][1] + " extra words", "en", "s1", 1) for i in range(5)]
    rows += [(1020 + i, prose(5000 + i, 100) + " " + question, "en", "s2", 1) for i in range(5)]
    rows += [(1030, None, None, None, None), (None, prose(9000, 50), "en", "s3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "output"]
    clean = {i for i in range(400) if i % 8}
    expected = [
        clean | set(range(1000, 1005)) | set(range(1010, 1015)) | set(range(1020, 1025)) | {1030, None},
        clean | set(range(1020, 1025)) | {1030, None},
        clean | {1030, None},
    ]
    now = docs
    for (_, work), ids in zip(corpus_pipeline.STAGES[:3], expected, strict=True):
        now = work(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        # The copies of toxic originals fall with them at the first stage.
        assert {r["doc_id"] for r in now.collect()} == ids - {1000 + i for i in range(5) if (i + 1) % 8 == 0}
    mixed = corpus_pipeline.mix_sources(spark, now, str(tmp_path))
    assert mixed.columns == docs.columns
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r[0]: r[1] for r in rows}
    facts = lambda d: np.array(tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()
    assert Counter(r["doc_id"] for r in result) == Counter(r["doc_id"] for r in mixed.collect())
    assert all((r["n_tokens"] * 4, r["ids_crc32"]) == (len(facts(r["doc_id"])), zlib.crc32(facts(r["doc_id"]))) for r in result)
    assert sum(r["n_tokens"] for r in result) == max(r["start"] + r["n_tokens"] for r in result)


def test_stages_take_empty_documents(spark, tmp_path, labels, benchmark):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, docs, str(tmp_path)).collect() == []
