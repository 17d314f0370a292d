"""Request validation: bounds, URL lists and the quarantine split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import seed_url

# Bounds of request fields per request kind, (smallest, largest, default).
NUMBER_BOUNDS = {
    "research": {"max_results": (1, 20, 5)},
    "crawl": {"max_depth": (1, 10, 3), "max_pages": (1, 100, 20)},
    "map": {"max_urls": (1, 5000, 500), "max_depth": (1, 20, 10)},
    "extract": {},
}
# Text lengths per request kind, (field, shortest, longest, required).
TEXT_BOUNDS = {
    "research": (("query", 1, 500, True), ("summary_prompt", 0, 2000, False)),
    "crawl": (("url", 1, 2048, True), ("summary_prompt", 0, 2000, False)),
    "map": (("url", 1, 2048, True),),
    "extract": (("prompt", 10, 2000, True),),
}
# Allowed words per request kind, (field, words, default).
CHOICES = {
    "map": (("discovery_method", ("sitemap", "crawl", "hybrid"), "hybrid"),),
    "extract": (("extract_mode", ("combined", "per_page"), "combined"),),
}
# List sizes.
MAX_RULES = 100
MAX_EXTRACT_URLS = 20


def _field(doc: Column, name: str, type_name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", type_name)


def _present(doc: Column, name: str) -> Column:
    raw = F.try_variant_get(doc, f"$.{name}", "variant")
    return raw.isNotNull()


def _kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def _violations(doc: Column, kind: str) -> Column:
    checks = []
    for name, (low, high, _) in NUMBER_BOUNDS[kind].items():
        number = _field(doc, name, "int")
        bad = _present(doc, name) & ~F.coalesce(number.between(low, high), F.lit(False))
        checks.append(F.when(bad, f"{name}: must be between {low} and {high}"))
    for name, low, high, required in TEXT_BOUNDS[kind]:
        raw = F.try_variant_get(doc, f"$.{name}", "variant")
        text = _field(doc, name, "string")
        fits = (_kind_of(raw) == "STRING") & F.char_length(text).between(low, high)
        absent = raw.isNull() if required else F.lit(False)
        # A JSON null counts as given for required fields and as absent for the others.
        given = raw.isNotNull() if required else (raw.isNotNull() & (_kind_of(raw) != "VOID"))
        bad = absent | (given & ~F.coalesce(fits, F.lit(False)))
        checks.append(F.when(bad, f"{name}: must be text of {low} to {high} characters"))
    for name, words, _ in CHOICES.get(kind, ()):
        word = _field(doc, name, "string")
        bad = _present(doc, name) & ~F.coalesce(word.isin(*words), F.lit(False))
        checks.append(F.when(bad, f"{name}: must be one of {', '.join(words)}"))
    for name in ("allow_domains", "block_domains"):
        entries = _field(doc, name, "array<string>")
        bad = _present(doc, name) & ~F.coalesce(F.size(entries) <= MAX_RULES, F.lit(False))
        checks.append(F.when(bad, f"{name}: must be a list of at most {MAX_RULES}"))
    if kind in ("crawl", "map"):
        checks.append(F.concat(F.lit("url: "), seed_url(_field(doc, "url", "string"))["reject_reason"]))
    if kind == "extract":
        checks.append(_url_list_violation(doc))
    return F.array_compact(F.array(*checks))


def url_specs(doc: Column) -> Column:
    """URL list of an extract request: array of (url, force_js_render, reject_reason).

    Entries are plain strings or objects with ``url`` and an optional ``force_js_render``.
    """
    items = F.try_variant_get(doc, "$.urls", "array<variant>")

    def spec(item: Column) -> Column:
        shape = _kind_of(item)
        text = F.when(shape == "STRING", item.try_cast("string")).when(
            shape.startswith("OBJECT"), F.try_variant_get(item, "$.url", "string")
        )
        missing = shape.startswith("OBJECT") & F.try_variant_get(item, "$.url", "variant").isNull()
        usable = seed_url(text)
        reason = (
            F.when(missing, "URL object is missing 'url'")
            .when((shape != "STRING") & ~shape.startswith("OBJECT"), "URL must be a string or an object")
            .otherwise(usable["reject_reason"])
        )
        return F.struct(
            F.when(reason.isNull(), usable["url"]).alias("url"),
            F.when(
                shape.startswith("OBJECT"), F.try_variant_get(item, "$.force_js_render", "boolean")
            ).alias("force_js_render"),
            reason.alias("reject_reason"),
        )

    return F.transform(items, spec)


def _url_list_violation(doc: Column) -> Column:
    items = F.try_variant_get(doc, "$.urls", "array<variant>")
    reasons = F.array_compact(F.transform(url_specs(doc), lambda s: s["reject_reason"]))
    return (
        F.when(items.isNull(), "urls: must be a list")
        .when(~F.size(items).between(1, MAX_EXTRACT_URLS), f"urls: must hold 1 to {MAX_EXTRACT_URLS} entries")
        .when(F.size(reasons) > 0, F.concat(F.lit("urls: "), F.get(reasons, F.lit(0))))
    )


def check_requests(requests: DataFrame, kind: str = "kind", payload: str = "payload") -> DataFrame:
    """Add ``doc`` (VARIANT) and ``violations`` (array of text, empty when the request is valid)."""
    parsed = requests.withColumn("doc", F.try_parse_json(F.col(payload)))
    found = F.when(
        F.col("doc").isNull() | ~F.schema_of_variant("doc").startswith("OBJECT"),
        F.array(F.lit("payload: must be a JSON object")),
    )
    for name in NUMBER_BOUNDS:
        found = found.when(F.col(kind) == name, _violations(F.col("doc"), name))
    return parsed.withColumn("violations", found.otherwise(F.array(F.lit("kind: unknown request kind"))))


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests and quarantined ones."""
    checked = check_requests(requests)
    return checked.where(F.size("violations") == 0), checked.where(F.size("violations") > 0)


def request_fields(valid: DataFrame, kind: str) -> DataFrame:
    """Typed columns of the valid requests of one kind, defaults filled in."""
    doc = F.col("doc")
    columns = [F.col("request_id")]
    for name, low, high, _ in TEXT_BOUNDS[kind]:
        if name == "url":
            columns.append(seed_url(_field(doc, "url", "string"))["url"].alias("url"))
        else:
            columns.append(_field(doc, name, "string").alias(name))
    for name, (_, _, default) in NUMBER_BOUNDS[kind].items():
        columns.append(F.coalesce(_field(doc, name, "int"), F.lit(default)).alias(name))
    for name, _, default in CHOICES.get(kind, ()):
        columns.append(F.coalesce(_field(doc, name, "string"), F.lit(default)).alias(name))
    columns.append(F.coalesce(_field(doc, "force_js_render", "boolean"), F.lit(False)).alias("force_js_render"))
    if kind == "extract":
        columns.append(url_specs(doc).alias("specs"))
    return valid.where(F.col("kind") == kind).select(*columns)


def explode_specs(requests: DataFrame) -> DataFrame:
    """One row per requested URL, 0-based ``position``; the entry's render flag wins over the request's."""
    return requests.select(
        "*", F.posexplode("specs").alias("position", "spec")
    ).select(
        "request_id",
        "position",
        F.col("spec.url").alias("url"),
        F.col("spec.force_js_render").alias("url_force_js_render"),
        F.coalesce("spec.force_js_render", "force_js_render").alias("force_js_render"),
    )
