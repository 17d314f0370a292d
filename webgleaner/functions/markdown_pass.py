"""The tag pass of ``markup`` in Python workers, shipped by value: the same Markdown, faster where very many pages are converted.

A move, by a tag out of a state, is worked out once and remembered, so that a page mostly costs one look-up a tag. States hold all
that counts but the address of an open link; what is remembered is bounded and made anew when it is full.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle

from . import markup as M
from . import text as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_MOVES = 100_000
_TAG = rf"({M.TAG})"
_NAME = r"<(/?[a-zA-Z][a-zA-Z0-9]*)"
_NAMES = frozenset(M._TAGS)
_BLOCKS = frozenset([*M.BLOCK_TAGS, *M._ends(M.BLOCK_TAGS)])
_LEVELS = {n: f"\n\n{'#' * level} " for level, n in enumerate(M.HEADINGS, 1)}
_HEADING_ENDS = frozenset(M._ends(M.HEADINGS))
_OPENS = {n: kind for kind, names in M._NAMES.items() for n in names}
_CLOSES = {f"/{n}": kind for n, kind in _OPENS.items()}
_MARKS, _BITS = M._MARKS, M._BITS
_LINE, _SOFT, _INDENT, _LINK, _LINK_END = M._LINE, M._SOFT, M._INDENT, M._LINK, M._LINK_END
_SPACES = str.maketrans("\t\r\n\f", "    ")
_KEPT = str.maketrans({"\n": M._LINE, "\r": M._LINE, " ": M._SPACE, "\t": M._TAB})
_PLACEHOLDERS = ((M._INDENT, "  "), (M._LINE, "\n"), (M._SPACE, " "), (M._TAB, "\t"))
_UNCLOSED = M._unclosed()
_ENTITY, _AMPERSAND = T._ENTITY, T._AMPERSAND
_CHARACTERS = {n: v for n, v in html.entities.html5.items() if n.endswith(";")}
_HREF = M.HREF
# Open lists, pre, whether a link is open, inline marks, tables, row, cell, rows, cells.
_START = ((), 0, False, 0, 0, False, False, 0, 0)


def moved(state: tuple, name: str) -> tuple[str, tuple]:
    """Text that a tag other than those of links leaves, and the state after it."""
    lists, pre, linked, inline, tables, row, cell, rows, cells = state
    grid, inside = tables == 1, bool(lists) or cell
    gap = " " if inside else "\n\n"
    cell_end = " |" if cell else ""
    # Behind the first row comes the line that makes it a table.
    row_end = cell_end + ("\n|" + " --- |" * max(cells, 1) if rows == 0 else "") if row else ""
    last = lists[-1] if lists else 0
    if name in _OPENS:
        kind = _OPENS[name]
        return _MARKS[kind][0] if kind != "code" or pre == 0 else "", (lists, pre, linked, inline | _BITS[kind], tables, row, cell, rows, cells)
    if name in _CLOSES:
        kind = _CLOSES[name]
        fits = inline & _BITS[kind] and (kind != "code" or pre == 0)
        return _MARKS[kind][1] if fits else "", (lists, pre, linked, inline & ~_BITS[kind], tables, row, cell, rows, cells)
    if name in ("ul", "ol"):
        emit = " " if cell else "" if lists else "\n\n"
        return emit, ((*lists, int(name == "ol")), pre, linked, inline, tables, row, cell, rows, cells)
    if name in ("/ul", "/ol"):
        emit = " " if cell else _SOFT if len(lists) > 1 else "\n\n"
        return emit, (lists[:-1], pre, linked, inline, tables, row, cell, rows, cells)
    if name in ("/td", "/th"):
        return cell_end if grid else " ", (lists, pre, linked, inline, tables, row, cell and not grid, rows, cells)
    if name == "/tr":
        if grid:
            return row_end, (lists, pre, linked, inline, tables, False, cell and not row, rows + row, cells)
        return " ", state
    if name == "br":
        return _LINE if pre else " " if cell else "\n", state
    # The others end links and marks that are open.
    if name in _BLOCKS:
        emit = " " if tables else gap
    elif name in _LEVELS:
        emit = " " if inside else _LEVELS[name]
    elif name in _HEADING_ENDS:
        emit = gap
    elif name == "li":
        emit = "\n" + _INDENT * max(len(lists) - 1, 0) + (f"{last}. " if last else "- ")
        lists = (*lists[:-1], last + 1) if last else lists
    elif name == "tr":
        emit = row_end + "\n|" if grid else gap
        if grid:
            rows, row, cell, cells = rows + row, True, False, 0
    elif name in ("td", "th"):
        emit = " "
        if grid and row:
            emit, cell, cells = cell_end + " ", True, cells + 1
    elif name == "table":
        emit = " " if tables else gap
        rows, tables = rows if tables else 0, tables + 1
    elif name == "/table":
        emit = row_end + "\n\n" if grid else " "
        if grid and row:
            rows, row, cell = rows + 1, False, False
        tables = max(tables - 1, 0)
    elif name == "pre":
        emit, pre = "" if pre else f"\n\n```{_LINE}", pre + 1
    elif name == "/pre":
        emit, pre = f"{_LINE}```\n\n" if pre == 1 else "", max(pre - 1, 0)
    else:  # hr
        emit = " " if inside else "\n\n---\n\n"
    return emit, (lists, pre, False, 0, tables, row, cell, rows, cells)


def character(entity: str) -> str | None:
    """Text of one character reference; None when the name is unknown."""
    body = entity[1:]
    if body[0] != "#":
        return _CHARACTERS.get(body)
    code = int(body[2:-1], 16) if body[1] in "xX" else int(body[1:-1])
    if code == 0xFEFF:  # a byte order mark, as the native decoder reads it
        return ""
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\ufffd"


def converter() -> Callable[[str], str]:
    """A function from main markup to Markdown, which remembers the moves it has seen."""
    split, name_of, href_of = re.compile(_TAG).split, re.compile(_NAME).match, re.compile(_HREF, re.ASCII).search
    unclosed, entities, ampersands = re.compile(_UNCLOSED).sub, re.compile(_ENTITY).findall, re.compile(_AMPERSAND)
    soft, breaks = re.compile(rf"{_SOFT}[ {_SOFT}]*+(?=\n|\Z)").sub, re.compile(r" \n ?|\n ").sub
    spaces, lines = re.compile(r" [ \xa0]+|\xa0[ \xa0]*+").sub, re.compile(r"\n{3,}").sub
    nodes: dict[tuple, tuple] = {}
    made = 0

    def node(state: tuple) -> tuple:
        """Moves out of a state, the state, and how texts are taken: 0 as they are, 1 in a cell, 2 in ``pre``."""
        found = nodes.get(state)
        if found is None:
            found = nodes[state] = ({}, state, 2 if state[1] else 1 if state[6] else 0)
        return found

    def walked(markup: str) -> str:
        nonlocal made
        if made > MOST_MOVES:
            nodes.clear()
            made = 0
        parts = split(markup)
        texts = parts[::2]
        plain = [t.translate(_SPACES) for t in texts] if "\0" in markup else "\0".join(texts).translate(_SPACES).split("\0")
        moves, state, mode = node(_START)
        href, out = "", []

        def text(i: int) -> str:
            return plain[i].replace("|", "\\|") if mode == 1 else texts[i].replace("\r\n", _LINE).translate(_KEPT)

        for i, tag in enumerate(parts[1::2]):
            if plain[i]:
                out.append(text(i) if mode else plain[i])
            move = moves.get(tag)
            if move is None:
                found = name_of(tag)
                name = found[1].lower() if found else ""
                if name == "a":
                    found = href_of(tag)
                    href = "".join(g or "" for g in found.groups()) if found else ""
                    move = (_LINK if href else "", node((*state[:2], bool(href), *state[3:])))
                elif name == "/a" and state[2]:
                    move = (f"{_LINK_END}({href})", node((*state[:2], False, *state[3:])))
                else:
                    if name == "/a" or name not in _NAMES:
                        move = ("", node(state))
                    else:
                        emit, after = moved(state, name)
                        move = (emit, node(after))
                    if len(tag) < 64:
                        moves[tag] = move
                        made += 1
            emit, (moves, state, mode) = move
            if emit:
                out.append(emit)
        if plain[-1]:
            out.append(text(len(plain) - 1) if mode else plain[-1])
        return "".join(out)

    def decoded(text: str) -> str:
        for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'")):
            text = text.replace(f"&{name};", char)
        for entity in dict.fromkeys(entities(text)):
            if not ampersands.search(entity):
                char = character(entity)
                text = text if char is None else text.replace(entity, char)
        return ampersands.sub("&", text)

    def markdown(markup: str) -> str:
        text = unclosed("", walked(markup))
        for start, end, mark in _MARKS.values():
            text = text.replace(start, mark).replace(end, mark)
        text = text.replace(_LINK, "[").replace(_LINK_END, "]")
        if "&" in text:
            text = decoded(text)
        if "  " in text or "\xa0" in text:
            text = spaces(" ", text)
        if _SOFT in text:
            text = soft("", text).replace(_SOFT, "\n")
        if " \n" in text or "\n " in text:
            text = breaks("\n", text)
        if "\n\n\n" in text:
            text = lines("\n\n", text)
        text = text.strip(" \n")
        for placeholder, char in _PLACEHOLDERS:
            text = text.replace(placeholder, char)
        return text

    return markdown


def markdown_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Markdown of batches of main markup (UTF-8 as binary); null stays null."""
    convert = converter()
    for batch in batches:
        yield pa.array([None if raw is None else convert(raw.decode("utf-8", "replace")) for raw in batch.to_pylist()], pa.string())
