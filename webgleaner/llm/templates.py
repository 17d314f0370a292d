"""Benchmark decontamination by templates, also of questions whose numbers, names or units were changed.

Texts become templates: numbers, names and units turn into typed placeholders (#, @, ~) and the rest into lower-case words. Windows of
template words are joined by hash with those of the benchmark. Where windows of one document and item line up, the values behind the
placeholders must be consistent: one benchmark value stands for one value in the document. Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, stage

WINDOW = 8
LEAST_WORDS = 4

# Number words and units that are placeholders.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion"
).split()
FIRST_LETTERS = "".join(sorted({c for word in NUMBER_WORDS for c in (word[0], word[0].upper())}))
UNITS = (
    "percent dollars dollar euros euro cents pounds kg g mg lb km m cm mm mile miles inch inches feet foot hour hours minute minutes "
    "second seconds day days week weeks month months year years liter liters litre litres ml degrees"
).split()

# Steps from text to valued words: pattern, replacement. The mark of a placeholder stands before its value.
STEPS = (
    (r"([0-9])[.,:/]([0-9])", r"$1$2"),
    (r"([0-9])[.,:/]([0-9])", r"$1$2"),
    # Only a letter that a number word begins with is worth trying them all.
    (rf"(?<![\p{{L}}#@~])(?=[{FIRST_LETTERS}])((?i:{'|'.join(NUMBER_WORDS)}))(?!\p{{L}})", r"#$1"),
    (r"([^.!?:;\s][\"')\]]*\s+)(\p{Lu}\p{Ll}+)", r"$1@$2"),
    (r"([^.!?:;\s][\"')\]]*\s+)(\p{Lu}\p{Ll}+)", r"$1@$2"),
    (r"([0-9]+)", r" #$1 "),
    (rf"(#[0-9A-Za-z]+\s+)({'|'.join(UNITS)})([^\p{{L}}]|$)", r"$1~$2$3"),
)
PUNCTUATION = r"[^\p{L}\p{N}#@~]+"


def valued_text(text: Column) -> Column:
    """Lower-case words joined by spaces, placeholders as mark and value; null is empty."""
    out = F.translate(F.coalesce(text, F.lit("")), "#@~", "   ")
    for pattern, replacement in STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(F.regexp_replace(F.lower(out), PUNCTUATION, " "))


def template_words(valued: Column) -> Column:
    """Words of the template: placeholders without their values."""
    return F.split(F.regexp_replace(valued, r"([#@~])[^ ]*", "$1"), " ")


def window_hashes(words: Column, values: Column, size: int, exact: Callable[[Column], Column] | None) -> Column:
    """``at, window, exact`` (1-based place and hashes) of the windows of ``size`` words; none for shorter texts.

    ``window`` is the hash of the template, in windows of fewer than 4 words that of the values behind its placeholders. ``exact`` is the hash
    with the values at places for which the condition ``exact`` holds, else null.
    """

    def hashed(i: Column) -> Column:
        window = F.xxhash64(F.slice(values if size < LEAST_WORDS else words, i, size))
        with_values = F.lit(None).cast("long") if exact is None else F.when(exact(i), F.xxhash64(F.slice(values, i, size)))
        return F.struct(i.alias("at"), window.alias("window"), with_values.alias("exact"))

    places = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, hashed)


def few_plain(words: Column, size: int) -> Callable[[Column], Column]:
    """Condition on a place: the window there has fewer than 4 plain words, so that its values must be equal too."""

    def found(i: Column) -> Column:
        plain = F.slice(words, i, size)
        for mark in "#@~":
            plain = F.array_remove(plain, mark)
        return F.size(plain) < LEAST_WORDS

    return found


def _windows(rows: DataFrame, keys: list[str], sizes: list[int], exact: Callable[[int], Callable[[Column], Column] | None]) -> DataFrame:
    """``keys, size, at, window, exact`` of every window of the given sizes; ``exact`` gives the condition for a size."""
    words = rows.select(*keys, template_words(F.col("_valued")).alias("_words"), F.split("_valued", " ").alias("_values"))
    parts = [
        words.select(*keys, F.lit(size).alias("size"), F.inline(window_hashes(F.col("_words"), F.col("_values"), size, exact(size)))) for size in sizes
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def template_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Matches of documents (``doc_id, text``) and items (``item_id, text``): ``doc_id, item_id, n_windows, n_slots, n_changed``.

    A row per document row and item that share at least one window of ``window`` template words (the whole item, if shorter) and
    consistent slots, in one alignment: the one with the most windows. Windows with fewer than 4 plain words must have equal values too. ``n_slots`` is
    the number of distinct benchmark values behind placeholders in it, ``n_changed`` how many stand for another value in the document. Null texts match
    nothing; rows with one id and one text count once; ids may be null; other columns are ignored.

    The benchmark's windows are broadcast while they are few; else both sides are joined by a shuffle on the window's hash. Texts are not shuffled
    unless very many documents match.
    """
    rows = docs.where("text is not null").select(
        F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_key"), valued_text(F.col("text")).alias("_valued")
    )
    items = benchmark.where("text is not null").select(F.col("item_id").alias("_item"), valued_text(F.col("text")).alias("_valued"))
    items = stage(items.dropDuplicates().withColumn("_n", F.size(F.split("_valued", " "))).where("_valued != ''"), "templates")
    sizes = sorted({min(window, r["_n"]) for r in items.groupBy(F.least("_n", F.lit(window)).alias("_n")).count().collect()}) or [window]
    # An item has windows of its own size only.
    few = lambda s: few_plain(F.col("_words"), s) if s >= LEAST_WORDS else None
    sized = [_windows(items.where(F.least("_n", F.lit(window)) == s), ["_item", "_valued"], [s], few) for s in sizes]
    targets = sized[0]
    for part in sized[1:]:
        targets = targets.unionByName(part)
    targets = targets.select("_item", "size", F.col("at").alias("_place"), "window", F.col("exact").alias("_exact")).dropDuplicates()
    targets = stage(targets, "template-windows")
    # The values of the documents' windows are hashed only for sizes at which an item needs them.
    needed = {r["size"] for r in targets.where("_exact is not null").select("size").distinct().collect()}
    every = lambda s: (lambda _: F.lit(True)) if s in needed else None
    hits = _windows(rows, ["_doc", "_key"], sizes, every).join(lookup(targets, 500_000), ["size", "window"]).where("_exact is null or _exact = exact")
    hits = hits.groupBy("_doc", "_key", "_item", "size", (F.col("at") - F.col("_place")).alias("_shift")).agg(
        F.collect_set("_place").alias("_places")
    )
    hits = stage(hits, "template-hits")
    # Valued words of the few documents with hits, to check the slots.
    found = stage(hits.select("_doc", "_key").distinct(), "template-documents")
    chosen = rows.alias("r").join(
        lookup(found).alias("f"), F.col("r._doc").eqNullSafe(F.col("f._doc")) & (F.col("r._key") == F.col("f._key")), "left_semi"
    )
    chosen = chosen.dropDuplicates(["_doc", "_key"]).select("_doc", "_key", F.split("_valued", " ").alias("_mine"))
    theirs = items.select("_item", F.split("_valued", " ").alias("_theirs"))
    checked = (
        hits.alias("h")
        .join(chosen.alias("c"), F.col("h._doc").eqNullSafe(F.col("c._doc")) & (F.col("h._key") == F.col("c._key")))
        .join(theirs.alias("t"), F.col("h._item").eqNullSafe(F.col("t._item")))
        .select("h._doc", "h._key", "h._item", "h.size", "h._shift", "h._places", "_mine", "_theirs")
    )
    return _consistent(checked)


def _consistent(checked: DataFrame) -> DataFrame:
    """Keep alignments whose slots are consistent; the best one per document and item."""
    marks = "'^[#@~]'"
    covered = F.expr("array_distinct(flatten(transform(_places, p -> sequence(p, p + size - 1))))")
    kept = checked.withColumn("_covered", covered)
    pairs = F.expr(
        f"array_distinct(transform(filter(_covered, p -> get(_theirs, p - 1) rlike {marks}), "
        "p -> struct(get(_theirs, p - 1) as a, get(_mine, p + _shift - 1) as b)))"
    )
    kept = kept.withColumn("_pairs", pairs).withColumn("n_slots", F.expr("size(array_distinct(transform(_pairs, x -> x.a)))"))
    kept = kept.where(F.size("_pairs") == F.col("n_slots")).withColumn("n_changed", F.expr("size(filter(_pairs, x -> x.a != x.b))"))
    best = F.max(F.struct(F.size("_places").alias("n_windows"), (-F.col("n_changed")).alias("less"), F.col("n_slots")))
    return (
        kept.groupBy("_doc", "_key", "_item")
        .agg(best.alias("_best"))
        .select(
            F.col("_doc").alias("doc_id"), F.col("_item").alias("item_id"), "_best.n_windows", "_best.n_slots",
            (-F.col("_best.less")).alias("n_changed"),
        )
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose id has a match; all columns stay, and rows without id or text."""
    gone = template_matches(docs, benchmark, window).select(F.col("doc_id").alias("_gone")).distinct()
    gone = lookup(stage(gone.where("_gone is not null"), "contaminated"))
    whole = docs.select(F.struct("*").alias("_row"))
    return whole.join(gone, F.col("_row.doc_id") == F.col("_gone"), "left_anti").select("_row.*")
