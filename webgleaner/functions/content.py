"""Page content columns: PDF test, script-noise test, link anchors, HTML to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markdown_pass import markdown_arrays
from .markup import CONTROLS, TAG, dense_run, markdown_of, tag_kinds, tag_tokens
from .text import SPACE, decode_entities, let, strip

# Shortest page text accepted from the static fetch; shortest main content.
MIN_CONTENT_CHARS = 200
MIN_MAIN_CHARS = 50

# Pages read from a PDF.
PDF_MAX_PAGES = 50

# Signs of script code, searched in lower-cased text.
SCRIPT_PATTERNS = (
    r"\bfunction\b",
    r"\bconst\b",
    r"\blet\b",
    r"\bvar\b",
    r"\bwindow\.",
    r"\bdocument\.",
    r"\bconsole\.",
    r"\btypeof\b",
    r"!function\b",
    r"\bfetch\s*\(",
    r"\bvoid\s+0\b",
    r"catch\s*\(",
    r"\.prototype\.",
    r"performance\.now\b",
)
# Hits per 1000 characters; few lines with many semicolons.
SCRIPT_DENSITY = 10.0
SCRIPT_MAX_LINES = 5
SCRIPT_MIN_SEMICOLONS = 50

_COMMENT_OR_CODE = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
_DROPPED = _COMMENT_OR_CODE + rf"|<(nav|footer|iframe|head)\b[^>]*>.*?</\2\s*>|{CONTROLS}"
_ATTRIBUTE = r"""[\s/]+(?!href[\s=/>])[^\s=>/"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']*+))?+"""
_ANCHOR = rf"""(?i)<a(?:{_ATTRIBUTE})*+[\s/]+href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)"""


def script_hits(text: Column) -> Column:
    """Number of script signs. Signs that can overlap others are counted in scans of their own."""
    low = F.lower(text)
    alone = (r"!function\b", r"\.prototype\.")
    words = "|".join(p[2:] for p in SCRIPT_PATTERNS if p.startswith(r"\b"))
    rest = "|".join(p for p in SCRIPT_PATTERNS if not p.startswith(r"\b") and p not in alone)
    hits = F.regexp_count(low, F.lit(rf"(?U)\b(?:{words})|{rest}"))
    for pattern, word in zip(alone, ("!function", ".prototype.")):
        hits = hits + F.when(
            F.contains(low, F.lit(word)), F.regexp_count(low, F.lit(f"(?U){pattern}"))
        ).otherwise(0)
    return hits


def is_script_noise(text: Column, min_chars: int = MIN_CONTENT_CHARS) -> Column:
    """True when a text of ``min_chars`` characters or more is mostly script code."""
    size = F.char_length(text)
    dense = script_hits(text) / (size / F.lit(1000.0)) > SCRIPT_DENSITY
    lines = size - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    marks = size - F.char_length(F.replace(text, F.lit(";"), F.lit("")))
    packed = (lines < SCRIPT_MAX_LINES) & (marks > SCRIPT_MIN_SEMICOLONS)
    return F.when(size < min_chars, False).otherwise(F.coalesce(dense | packed, F.lit(False)))


def looks_like_pdf(url: Column, content_type: Column, body: Column) -> Column:
    """PDF by content type, by ``.pdf`` before the query or by the magic bytes of the body."""
    by_type = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf"))
    by_name = F.endswith(F.lower(F.regexp_extract(url, r"\A([^?]*)", 1)), F.lit(".pdf"))
    by_magic = F.coalesce(F.substring(body, 1, 5) == F.lit(b"%PDF-"), F.lit(False))
    return by_type | by_name | by_magic


def decode_body(body: Column) -> Column:
    """UTF-8 text of a binary body; bad bytes become U+FFFD."""
    return F.make_valid_utf8(body.cast("string"))


def anchor_hrefs(html: Column) -> Column:
    """Trimmed, decoded href values of the ``<a>`` tags in page order.

    Anchors inside comments, scripts and style sheets do not count.
    """
    live = F.regexp_replace(html, _COMMENT_OR_CODE, "")
    raw = F.regexp_extract_all(live, F.lit(_ANCHOR), F.lit(1))
    return F.transform(
        raw, lambda v: strip(decode_entities(F.regexp_replace(v, r"""\A["']|["']\z""", "")))
    )


def html_title(html: Column) -> Column:
    """Text of the first ``<title>`` or NULL."""
    raw = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    text = strip(F.regexp_replace(decode_entities(raw), rf"{SPACE}+", " "))
    return F.when(text != "", text)


def _live(html: Column) -> Column:
    """``html`` without what is never content; the pattern is only tried on texts that hold one of its starts."""

    def kept(low: Column) -> Column:
        found = html.rlike(CONTROLS)
        for start in ("<!--", "<script", "<style", "<nav", "<footer", "<iframe", "<head"):
            found = found | F.contains(low, F.lit(start))
        return F.when(found, F.regexp_replace(html, _DROPPED, "")).otherwise(html)

    return let(F.lower(html), kept)


def _main_markup(live: Column, min_chars: int) -> Column:
    """First article or main element when it holds enough text, else the densest run of blocks with as much, else the whole body."""
    main = F.regexp_extract(live, r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>", 2)
    dense = let(dense_run(live), lambda run: F.when(run["chars"] >= min_chars, run["markup"]).otherwise(live))

    def chosen(m: Column) -> Column:
        words = F.trim(F.regexp_replace(m, TAG, ""), F.lit(" \t\r\n\f"))
        return F.when(F.char_length(words) >= min_chars, m).otherwise(dense)

    return let(main, chosen)


def with_main_content(pages: DataFrame, html: str = "html", min_main_chars: int = MIN_MAIN_CHARS) -> DataFrame:
    """Add ``live`` (``html`` without comments, script, style, head, nav, footer and iframe) and ``run``, its densest blocks.

    ``run`` is a struct of ``first, last, chars, blocks, markup`` (see ``dense_run``), NULL where they hold less than ``min_main_chars``.
    """
    live = pages.withColumn("live", F.regexp_replace(F.col(html), _DROPPED, ""))
    run = live.withColumn("run", dense_run(F.col("live")))
    return run.withColumn("run", F.when(F.col("run.chars") >= min_main_chars, F.col("run")))


def with_markdown(
    pages: DataFrame, html: str = "html", name: str = "markdown", min_main_chars: int = MIN_MAIN_CHARS, in_python: bool = False
) -> DataFrame:
    """Add the Markdown of the main content of ``html``: the first article or main element with ``min_main_chars``, else the run of blocks
    with the densest text, else the body.

    Comments, script, style, head, nav, footer and iframe go with their content. The steps are
    separate projections because a result is used more than once and must not be computed twice. ``in_python`` takes the tag pass, the dearest
    step, to Python workers (see ``markdown_pass``): the same Markdown in less time where very many pages are converted.
    """
    main = pages.withColumn("_live", _live(F.col(html))).withColumn("_markup", _main_markup(F.col("_live"), min_main_chars))
    if in_python:
        made = F.arrow_udf(markdown_arrays, "string")(F.col("_markup").cast("binary"))
        # Used twice, so that it stays a column: Spark 4.1 does not find the function again if the expression is moved inside.
        return main.withColumn(name, F.when(F.col("_markup").isNotNull(), made).otherwise("")).drop("_live", "_markup")
    return (
        main.withColumn("_tokens", tag_tokens(F.col("_markup")))
        .withColumn("_kinds", tag_kinds(F.col("_tokens")))
        .withColumn(name, F.coalesce(markdown_of(F.arrays_zip("_tokens", "_kinds")), F.lit("")))
        .drop("_live", "_markup", "_tokens", "_kinds")
    )
