"""Text helpers shared by the other function modules."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes, as a Java character class.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

_AMPERSAND = r"&(?:amp|AMP|#0*38|#[xX]0*26);"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside ``body`` so that it is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim white space at both ends. Linear: a run of spaces is looked at once."""
    return F.regexp_replace(text, rf"\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def is_blank(text: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return text.isNull() | ~text.rlike(rf"(?!{SPACE})(?s:.)")


def cap(text: Column, limit: int, marker: str = "") -> Column:
    """First ``limit`` characters plus ``marker`` when the text is longer."""
    return F.when(
        F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))
    ).otherwise(text)


@lru_cache(maxsize=1)
def _entity_names() -> str:
    """JSON object of the HTML 5 entity names, taken from the standard library."""
    names = {n[:-1]: v for n, v in html.entities.html5.items() if n.endswith(";")}
    return json.dumps(names, ensure_ascii=True)


def _entity_value(entity: Column) -> Column:
    """Text of one character reference; NULL when the name is unknown."""
    body = F.substring(entity, 2, 40)
    digits = F.regexp_extract(body, r"^#([0-9]+);", 1)
    hexes = F.regexp_extract(body, r"^#[xX]([0-9a-fA-F]+);", 1)
    code = F.when(digits != "", digits.try_cast("bigint")).when(
        hexes != "", F.conv(hexes, 16, 10).try_cast("bigint")
    )
    legal = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(
        F.unhex(F.lpad(F.hex(F.when(legal, code).otherwise(F.lit(0xFFFD))), 8, "0")), "utf-32"
    )
    names = F.from_json(F.lit(_entity_names()), "map<string,string>")
    return F.when(code.isNotNull(), char).otherwise(
        F.try_element_at(names, F.regexp_extract(body, r"^([A-Za-z0-9]+);", 1))
    )


def decode_entities(text: Column) -> Column:
    """Replace HTML character references; each kind that occurs is looked up once per text.

    Forms of the ampersand itself come last and in one pass, so nothing is decoded twice.
    """
    def decoded(text: Column) -> Column:
        common = text
        for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'")):
            common = F.replace(common, F.lit(f"&{name};"), F.lit(char))
        return let(common, others)

    def others(common: Column) -> Column:
        found = F.filter(
            F.array_distinct(F.regexp_extract_all(common, F.lit(_ENTITY), F.lit(0))),
            lambda e: ~e.rlike(_AMPERSAND),
        )
        made = F.aggregate(
            found, common, lambda acc, e: F.replace(acc, e, F.coalesce(_entity_value(e), e))
        )
        return F.regexp_replace(made, _AMPERSAND, "&")

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))
