"""Markup as a row of tags and texts: Markdown by one pass with a stack, main content by text density."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import decode_entities, let

TAG = r"<[a-zA-Z/!?][^>]*>"
# A tag, a declaration, or text.
TOKEN = r"<[a-zA-Z/!?][^>]*>|[^<]+|<"
BLOCK_TAGS = (
    "address article aside blockquote body caption dd div dl dt fieldset figcaption figure form header html main p section tbody tfoot thead"
).split()
HEADINGS = [f"h{level}" for level in range(1, 7)]
# Characters that stand for things inside the converter; texts are cleaned of them first.
CONTROLS = r"[\x00-\x08\x0b\x0e-\x1f]+"
_LINE, _SPACE, _TAB, _SOFT, _INDENT = "\x03", "\x04", "\x07", "\x05", "\x06"
# Inline marks: open, close, Markdown.
_MARKS = {"b": ("\x10", "\x11", "**"), "i": ("\x12", "\x13", "*"), "code": ("\x14", "\x15", "`")}
_NAMES = {"b": ("b", "strong"), "i": ("i", "em"), "code": ("code",)}
_LINK, _LINK_END = "\x16", "\x17"
_BITS = {kind: 1 << n for n, kind in enumerate(_MARKS)}
_GRID = "struct<tables:int, row:boolean, cell:boolean, rows:int, cells:int>"
_STATE = f"struct<out:string, lists:array<int>, pre:int, href:string, inline:int, grid:{_GRID}>"
# Tokens of one inner pass: the text it gathers is copied at each step, so that passes must be short.
_PASS = 64


def tag_tokens(markup: Column) -> Column:
    """Tags, declarations and texts in order."""
    return F.regexp_extract_all(markup, F.lit(TOKEN), F.lit(0))


_ANY_BLOCK = [*BLOCK_TAGS, *(f"/{n}" for n in BLOCK_TAGS), *HEADINGS, *(f"/{n}" for n in HEADINGS), "li", "tr", "td", "th", "table", "/table", "pre", "/pre", "hr"]
# The tags that count, numbered from 1 in this order, so that groups are ranges of numbers.
_TAGS = [*_ANY_BLOCK, "/td", "/th", "/tr", "ul", "ol", "/ul", "/ol", "a", "/a", "br"]
for _kind in _NAMES.values():
    _TAGS += [*_kind, *(f"/{n}" for n in _kind)]


def _perfect(names: list[str]) -> tuple[list[int], int]:
    """The least table in which CRC-32 gives each name a place of its own, and its size: the number of a name, 0 where there is none."""
    sums = [zlib.crc32(n.encode()) for n in names]
    size = next(n for n in range(len(names), 1 << 20) if len({c % n for c in sums}) == len(names))
    found = [0] * size
    for number, c in enumerate(sums, 1):
        found[c % size] = number
    return found, size


_BARE = [f"<{n}>" for n in _TAGS]
_PLACES, _SIZE = _perfect(_BARE)


def tag_kinds(tokens: Column) -> Column:
    """For each of ``tag_tokens`` the number of its tag: 0 for tags that do not count and declarations, -1 for texts."""

    def named(token: Column) -> Column:
        name = F.regexp_extract(token, r"\A<(/?[a-zA-Z][a-zA-Z0-9]*)", 1)
        return let(name, lambda n: F.when(n == "", 0).otherwise(F.find_in_set(F.lower(n), F.lit(",".join(_TAGS)))))

    def kind(token: Column) -> Column:
        place = F.get(F.lit(_PLACES), (F.crc32(token.cast("binary")) % _SIZE).cast("int"))
        bare = let(place, lambda k: F.when(F.get(F.lit(["", *_BARE]), k) == token, k).otherwise(named(token)))
        return F.when(F.startswith(token, F.lit("<")) & (token != "<"), bare).otherwise(-1)

    return F.transform(tokens, kind)


HREF = r"""(?i)\shref\s*=\s*(?:"([^">]*)|'([^'>]*)|([^\s"'>]+))"""


def _href(tag: Column) -> Column:
    return F.concat(*(F.regexp_extract(tag, HREF, group) for group in (1, 2, 3)))


def _ends(names: list[str]) -> list[str]:
    return [f"/{n}" for n in names]


def _last(lists: Column) -> Column:
    return F.get(lists, F.size(lists) - 1)


def _by_kind(kind: Column, leaves: list[tuple[int, Column]]) -> Column:
    """The leaf whose number, the last of its kinds, is the first not below ``kind``: by halving, so that a step looks at few conditions."""
    if len(leaves) == 1:
        return leaves[0][1]
    half = len(leaves) // 2
    return F.when(kind <= leaves[half - 1][0], _by_kind(kind, leaves[:half])).otherwise(_by_kind(kind, leaves[half:]))


def _step(s: Column, token: Column, kind: Column) -> Column:
    """State after a text or tag, with the text that it leaves behind ``out``. Each sort of tag has its own branch."""
    lists, depth, pre, inline, grid = s["lists"], F.size(s["lists"]), s["pre"], s["inline"], s["grid"]
    tables, row, cell, rows, cells = (grid[n] for n in ("tables", "row", "cell", "rows", "cells"))
    none, nothing = F.lit(None).cast("string"), F.lit("")

    def but(emit: Column | str | None = None, **changes: Column) -> Column:
        if emit is not None:
            changes["out"] = F.concat(s["out"], F.lit(emit) if isinstance(emit, str) else emit)
        return F.struct(*(changes.get(n, s[n]).alias(n) for n in ("out", "lists", "pre", "href", "inline", "grid")))

    def block(emit: Column | str, **changes: Column) -> Column:
        return but(emit, href=none, inline=F.lit(0), **changes)

    def table(**changes: Column) -> Column:
        return F.struct(*(changes.get(n, grid[n]).alias(n) for n in ("tables", "row", "cell", "rows", "cells")))

    top = F.slice(lists, 1, F.greatest(depth - 1, F.lit(0)))
    counts = tables == 1
    inside = (depth > 0) | cell
    gap = F.when(inside, " ").otherwise("\n\n")
    cell_end = F.when(cell, " |").otherwise("")
    # Behind the first row comes the line that makes it a table.
    rule = F.when(rows == 0, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.greatest(cells, F.lit(1))))).otherwise("")
    row_end = F.when(row, F.concat(cell_end, rule)).otherwise("")
    ended = counts & row
    left = {"rows": F.when(ended, rows + 1).otherwise(rows), "cell": cell & ~ended, "row": row & ~ended}
    number = F.when(_last(lists) > 0, F.concat(_last(lists).cast("string"), F.lit(". "))).otherwise("- ")
    item = F.concat(F.lit("\n"), F.repeat(F.lit(_INDENT), F.greatest(depth - 1, F.lit(0))), number)
    counted = F.when(_last(lists) > 0, F.concat(top, F.array(_last(lists) + 1))).otherwise(lists)
    marked = F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), kind - _TAGS.index("h1")), F.lit(" "))
    listed = F.concat(lists, F.array(F.when(kind == _TAGS.index("ol") + 1, 1).otherwise(0)))
    leaves = {
        "": but(_text(pre, cell, token)),
        _ends(BLOCK_TAGS)[-1]: block(F.when(tables > 0, " ").otherwise(gap)),
        "h6": block(F.when(inside, " ").otherwise(marked)),
        "/h6": block(gap),
        "li": block(item, lists=counted),
        "tr": F.when(counts, block(F.concat(row_end, F.lit("\n|")), grid=table(rows=left["rows"], row=F.lit(True), cell=F.lit(False), cells=F.lit(0)))).otherwise(block(gap)),
        "th": F.when(ended, block(F.concat(cell_end, F.lit(" ")), grid=table(cells=cells + 1, cell=F.lit(True)))).otherwise(block(" ")),
        "table": block(F.when(tables == 0, gap).otherwise(" "), grid=table(tables=tables + 1, rows=F.when(tables == 0, 0).otherwise(rows))),
        "/table": block(
            F.when(counts, F.concat(row_end, F.lit("\n\n"))).otherwise(" "), grid=table(tables=F.greatest(tables - 1, F.lit(0)), **left)
        ),
        "pre": block(F.when(pre > 0, "").otherwise(f"\n\n```{_LINE}"), pre=pre + 1),
        "/pre": block(F.when(pre == 1, f"{_LINE}```\n\n").otherwise(""), pre=F.greatest(pre - 1, F.lit(0))),
        "hr": block(F.when(inside, " ").otherwise("\n\n---\n\n")),
        "/th": F.when(counts, but(cell_end, grid=table(cell=F.lit(False)))).otherwise(but(" ")),
        "/tr": F.when(counts, but(row_end, grid=table(**left))).otherwise(but(" ")),
        "ol": but(F.when(cell, " ").when(depth == 0, "\n\n").otherwise(""), lists=listed),
        "/ol": but(F.when(cell, " ").when(depth > 1, _SOFT).otherwise("\n\n"), lists=top),
        "a": let(_href(token), lambda href: but(F.when(href != "", _LINK).otherwise(""), href=F.nullif(href, nothing))),
        "/a": but(F.when(s["href"].isNotNull(), F.concat(F.lit(_LINK_END + "("), s["href"], F.lit(")"))).otherwise(""), href=none),
        "br": but(F.when(pre > 0, _LINE).when(cell, " ").otherwise("\n")),
    }
    for mark, (start, end, _) in _MARKS.items():
        bit, names = F.lit(_BITS[mark]), list(_NAMES[mark])
        fits = (pre == 0) if mark == "code" else F.lit(True)
        is_open = inline.bitwiseAND(bit) > 0
        leaves[names[-1]] = but(F.when(fits, start).otherwise(""), inline=inline.bitwiseOR(bit))
        leaves[_ends(names)[-1]] = but(F.when(fits & is_open, end).otherwise(""), inline=inline.bitwiseAND(F.bitwise_not(bit)))
    return _by_kind(kind, [(_TAGS.index(n) + 1 if n else -1, leaf) for n, leaf in leaves.items()])


def _text(pre: Column, cell: Column, token: Column) -> Column:
    """Text of a text token: white space kept in ``pre``, bars escaped in table cells."""
    kept = token
    for char, placeholder in (("\r\n", _LINE), ("\n", _LINE), ("\r", _LINE), (" ", _SPACE), ("\t", _TAB)):
        kept = F.replace(kept, F.lit(char), F.lit(placeholder))
    plain = token
    for char in "\t\r\n\f":
        plain = F.replace(plain, F.lit(char), F.lit(" "))
    return F.when(pre > 0, kept).when(cell, F.replace(plain, F.lit("|"), F.lit("\\|"))).otherwise(plain)


def _walked(tokens: Column) -> Column:
    """Texts of all tokens (array of ``_tokens, _kinds``) by one pass with the state; the state holds the stack of open lists."""
    grid = F.struct(F.lit(0).alias("tables"), F.lit(False).alias("row"), F.lit(False).alias("cell"), F.lit(0).alias("rows"), F.lit(0).alias("cells"))
    start = F.struct(
        F.lit("").alias("out"), F.array().cast("array<int>").alias("lists"), F.lit(0).alias("pre"), F.lit(None).cast("string").alias("href"),
        F.lit(0).alias("inline"), grid.alias("grid"),
    ).cast(_STATE)

    def inner(acc: Column, part: Column) -> Column:
        again = F.struct(F.lit("").alias("out"), *(acc["s"][n].alias(n) for n in ("lists", "pre", "href", "inline", "grid")))
        done = F.aggregate(part, again, lambda s, token: _step(s, token["_tokens"], token["_kinds"]))
        return let(done, lambda d: F.struct(d.alias("s"), F.array_append(acc["out"], d["out"]).alias("out")))

    def walk(counting: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(counting) - 1) / _PASS).cast("int")), lambda i: F.slice(counting, i * _PASS + 1, _PASS)
        )
        none = F.array().cast("array<string>")
        walked = F.aggregate(parts, F.struct(start.alias("s"), none.alias("out")), inner, lambda acc: F.array_join(acc["out"], ""))
        return F.when(F.size(counting) > 0, walked).otherwise("")

    # Tags that do not count leave no text and change nothing.
    return let(F.filter(tokens, lambda t: t["_kinds"] != 0), walk)


def _unclosed() -> str:
    """Pattern of the openings of marks and links without an end in their line."""
    pairs = [*((start, end) for start, end, _ in _MARKS.values()), (_LINK, _LINK_END)]
    return "|".join(rf"{start}(?![^{start}{end}\n]*+{end})" for start, end in pairs)


def _spaced(text: Column) -> Column:
    """Single white space, and what the placeholders stand for. A pattern is only tried on texts that hold what it needs."""

    def where(text: Column, needed: tuple[str, ...], made: Callable[[Column], Column]) -> Column:
        def tried(t: Column) -> Column:
            found = F.contains(t, F.lit(needed[0]))
            for other in needed[1:]:
                found = found | F.contains(t, F.lit(other))
            return F.when(found, made(t)).otherwise(t)

        return let(text, tried)

    text = where(text, ("  ", "\xa0"), lambda t: F.regexp_replace(t, r" [ \xa0]+|\xa0[ \xa0]*+", " "))
    text = where(text, (_SOFT,), lambda t: F.replace(F.regexp_replace(t, rf"{_SOFT}[ {_SOFT}]*+(?=\n|\z)", ""), F.lit(_SOFT), F.lit("\n")))
    text = where(text, (" \n", "\n "), lambda t: F.regexp_replace(t, r" \n ?|\n ", "\n"))
    text = F.trim(where(text, ("\n\n\n",), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n")), F.lit(" \n"))
    for placeholder, char in ((_INDENT, "  "), (_LINE, "\n"), (_SPACE, " "), (_TAB, "\t")):
        text = F.replace(text, F.lit(placeholder), F.lit(char))
    return text


def _finished(text: Column) -> Column:
    """Inline marks that were closed in their block become Markdown, entities characters, white space single."""
    text = F.regexp_replace(text, _unclosed(), "")
    for start, end, mark in _MARKS.values():
        text = F.replace(F.replace(text, F.lit(start), F.lit(mark)), F.lit(end), F.lit(mark))
    text = F.replace(F.replace(text, F.lit(_LINK), F.lit("[")), F.lit(_LINK_END), F.lit("]"))
    return _spaced(decode_entities(text))


def markdown_of(tokens: Column) -> Column:
    """Markdown of an array of (``_tokens``, ``_kinds``) made by ``tag_tokens`` and ``tag_kinds``.

    Headings, paragraphs, bold, italics, links, code, ``pre`` as fenced code, lists nested to any depth and numbered ones, tables with a header line.
    Block tags inside list items and cells are spaces; tables inside cells are text. A mark or link not closed in its block is left out.
    """
    return _finished(let(tokens, _walked))


# --- main content -----------------------------------------------------------------------------------------------------

# Our own weights: a block counts its characters outside links less those inside, four times, its neighbours up to NEAR each, less COST;
# a heading costs less.
NEAR = 100
COST = 200
HEADING_COST = 50
_STARTS = "|".join([*BLOCK_TAGS, *HEADINGS, "li", "ol", "pre", "table", "tr", "ul"])
_ANCHOR_TEXT = r"(?is)<a\b[^>]*>.*?</a\s*>"
_NO_TEXT = rf"{TAG}|[ \t\r\n\f]+"


def markup_blocks(live: Column) -> Column:
    """Markup cut before each start tag of a block."""
    return F.split(F.regexp_replace(live, rf"(?i)(<(?:{_STARTS})\b)", "\x01$1"), "\x01")


def _chars(markup: Column) -> Column:
    return F.char_length(F.regexp_replace(markup, _NO_TEXT, ""))


def dense_run(live: Column) -> Column:
    """The run of blocks with the largest sum of scores: ``first``, ``last`` (numbers from 0), ``chars``, ``blocks`` and the ``markup`` of the run.

    NULL if no block scores. Of equal runs the one that ends first, of these the shortest.
    """

    def picked(blocks: Column) -> Column:
        weights = F.transform(
            blocks,
            lambda b: let(
                _chars(b),
                lambda n: F.struct(
                    n.alias("n"),
                    F.when(F.contains(F.lower(b), F.lit("<a")), 2 * _chars(F.regexp_replace(b, _ANCHOR_TEXT, "")) - n).otherwise(n).alias("own"),
                    F.when(b.rlike(r"\A<[hH][1-6]"), HEADING_COST).otherwise(COST).alias("cost"),
                ),
            ),
        )
        return let(weights, lambda w: _best(blocks, w))

    return let(markup_blocks(live), picked)


def _best(blocks: Column, weights: Column) -> Column:
    def near(i: Column) -> Column:
        own = F.when(i >= 0, F.get(weights, i)["own"])
        return F.least(F.greatest(F.coalesce(own, F.lit(0)), F.lit(-NEAR)), F.lit(NEAR))

    scores = F.transform(weights, lambda w, i: 4 * w["own"] + near(i - 1) + near(i + 1) - w["cost"])
    start = F.expr("named_struct('i', 0, 'sum', 0, 'start', 0, 'best', 0, 'first', -1, 'last', -1)")

    def step(acc: Column, score: Column) -> Column:
        going = acc["sum"] > 0
        total = F.when(going, acc["sum"]).otherwise(0) + score
        begin = F.when(going, acc["start"]).otherwise(acc["i"])
        better = total > acc["best"]
        return F.struct(
            (acc["i"] + 1).alias("i"), total.alias("sum"), begin.alias("start"), F.when(better, total).otherwise(acc["best"]).alias("best"),
            F.when(better, begin).otherwise(acc["first"]).alias("first"), F.when(better, acc["i"]).otherwise(acc["last"]).alias("last"),
        )

    def result(run: Column) -> Column:
        size = run["last"] - run["first"] + 1
        chars = F.aggregate(F.slice(weights, run["first"] + 1, size), F.lit(0), lambda total, w: total + w["n"])
        return F.when(
            run["first"] >= 0,
            F.struct(
                run["first"].alias("first"), run["last"].alias("last"), chars.alias("chars"), F.size(blocks).alias("blocks"),
                F.array_join(F.slice(blocks, run["first"] + 1, size), "").alias("markup"),
            ),
        )

    return let(F.aggregate(scores, start, step), result)
