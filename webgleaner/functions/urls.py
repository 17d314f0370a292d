"""URL columns: parts, canonical form, reference resolution, same-site test, path filters.

The parts follow the generic syntax of RFC 3986 (Appendix B) with the leniency of Python's
``urllib.parse``: spaces and underscores are accepted, tab and newline characters are dropped,
``;parameters`` of the last path segment are a part of their own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import uses_netloc, uses_params, uses_relative

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, let, strip

# Schemes not followed when links are collected.
SKIPPED_SCHEMES = ("mailto", "tel", "javascript", "data", "ftp", "file")

# Longest accepted URL.
MAX_URL_CHARS = 2048

# Scheme lists of the standard library; the empty scheme is in each.
_WITH_PARAMS, _WITH_NETLOC, _RELATIVE = uses_params, uses_netloc, uses_relative

_SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"
_PARAMS = r";([^/]*)\z"
_DOT_SEGMENT = r"(?:\A|/)\.\.?(?:/|\z)"
# Absolute path without dot segments, empty segments, parameters, query or white space.
_PLAIN_PATH = r"\A(?:/(?!\.{1,2}(?:/|\z)|/)[^/?#;\s\x00-\x20]*+)++\z"


def _one_of(scheme: Column, names: list[str]) -> Column:
    return F.contains(F.lit("|" + "|".join(names) + "|"), F.concat(F.lit("|"), scheme, F.lit("|")))


def _clean(url: Column) -> Column:
    return F.when(
        url.rlike(r"\A[\x00-\x20]|[\t\r\n]"), F.regexp_replace(url, r"\A[\x00-\x20]+|[\t\r\n]", "")
    ).otherwise(url)


def split_url(url: Column) -> Column:
    """Struct of scheme, netloc, path, params, query, fragment; NULL when brackets are unbalanced."""

    def parts(u: Column) -> Column:
        head = F.regexp_extract(u, _SCHEME, 0)
        return let(
            F.struct(
                F.lower(F.rtrim(head, F.lit(":"))).alias("scheme"),
                F.substr(u, F.char_length(head) + 1).alias("rest"),
            ),
            lambda s: after_scheme(s["scheme"], s["rest"]),
        )

    def after_scheme(scheme: Column, rest: Column) -> Column:
        netloc = F.when(rest.startswith("//"), F.regexp_extract(rest, r"\A//([^/?#]*)", 1)).otherwise("")
        path = F.regexp_extract(rest, r"\A(?://[^/?#]*)?([^?#]*)", 1)
        has_params = F.contains(rest, F.lit(";")) & _one_of(scheme, _WITH_PARAMS)
        has_query, has_fragment = F.contains(rest, F.lit("?")), F.contains(rest, F.lit("#"))
        made = F.struct(
            scheme.alias("scheme"),
            netloc.alias("netloc"),
            F.when(has_params, F.regexp_replace(path, _PARAMS, "")).otherwise(path).alias("path"),
            F.when(has_params, F.regexp_extract(path, _PARAMS, 1)).otherwise("").alias("params"),
            F.when(has_query, F.regexp_extract(rest, r"\A[^?#]*\?([^#]*)", 1)).otherwise("").alias("query"),
            F.when(has_fragment, F.regexp_extract(rest, r"(?s)#(.*)", 1)).otherwise("").alias("fragment"),
        )
        odd = F.contains(netloc, F.lit("[")) != F.contains(netloc, F.lit("]"))
        return F.when(F.contains(rest, F.lit("[")) | F.contains(rest, F.lit("]")), F.when(~odd, made)).otherwise(made)

    # Bound first: the argument may itself be a long expression.
    return let(url, lambda given: let(_clean(given), parts))


def host_of(netloc: Column) -> Column:
    """Lower-case host of an authority: user info, port and brackets removed."""
    info = F.regexp_replace(netloc, r"(?s)\A.*@", "")
    host = F.when(
        F.contains(info, F.lit("[")), F.regexp_extract(info, r"\[([^\]]*)", 1)
    ).otherwise(F.regexp_extract(info, r"\A([^:]*)", 1))
    return F.lower(host)


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, ``''`` when there is none."""

    def host(u: Column) -> Column:
        rest = F.regexp_replace(_clean(u), _SCHEME, "")
        return let(F.regexp_extract(rest, r"\A//([^/?#]*)", 1), host_of)

    return let(url, host)


def port_of(netloc: Column) -> Column:
    """Port number of an authority or NULL."""
    info = F.regexp_replace(netloc, r"(?s)\A.*@", "")
    return F.regexp_extract(info, r"\A(?:[^\[]*\[[^\]]*\]|[^:\[]*):([0-9]{1,5})\z", 1).try_cast("int")


def url_path(url: Column) -> Column:
    """Path as shown in results: ``/`` when empty."""
    return let(split_url(url)["path"], lambda path: F.when(path == "", "/").otherwise(path))


def _join(scheme, netloc, path, params, query, fragment) -> Column:
    full = F.concat(path, F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""))

    def text(p: Column) -> Column:
        body = (
            F.when(
                netloc != "",
                F.concat(
                    F.lit("//"), netloc, F.when((p != "") & ~p.startswith("/"), "/").otherwise(""), p
                ),
            )
            .when(
                p.startswith("//")
                | ((scheme != "") & _one_of(scheme, _WITH_NETLOC) & ((p == "") | p.startswith("/"))),
                F.concat(F.lit("//"), p),
            )
            .otherwise(p)
        )
        return F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            body,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
            F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
        )

    return let(full, text)


def canonical_text(p: Column, strip_query: bool | Column) -> Column:
    """Canonical text of a split URL."""
    path = (
        F.when(p["path"] == "", "/")
        .when(F.char_length(p["path"]) > 1, F.regexp_replace(p["path"], r"(?<!/)/++\z|\A/{2,}+\z", ""))
        .otherwise(p["path"])
    )
    bare = F.lit(strip_query) if isinstance(strip_query, bool) else strip_query
    return _join(
        F.when(p["scheme"] == "", "https").otherwise(p["scheme"]),
        F.lower(p["netloc"]),
        path,
        F.when(bare, "").otherwise(p["params"]),
        F.when(bare, "").otherwise(p["query"]),
        F.lit(""),
    )


def normalize_url(url: Column, strip_query: bool | Column = False) -> Column:
    """Canonical form used as the key for de-duplication; ``''`` for blank input.

    https is added when ``://`` is missing, scheme and authority are lower-cased, the fragment and
    all trailing slashes go; ``strip_query`` also drops query and parameters.
    """

    def canonical(text: Column) -> Column:
        scheme = F.when(F.contains(text, F.lit("://")), "").otherwise("https://")
        return let(split_url(F.concat(scheme, text)), lambda p: canonical_text(p, strip_query))

    return let(
        strip(url), lambda text: F.when(text.isNull() | (text == ""), "").otherwise(canonical(text))
    )


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; ``..`` at the top is ignored."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    # A reference that ends in a dot segment names a folder.
    folder = path.rlike(r"(?:\A|/)\.\.?\z")
    resolved = let(
        kept,
        lambda k: F.concat(
            F.array_join(k, "/"), F.when(folder & (F.size(k) > 0), "/").otherwise("")
        ),
    )
    return F.when(path.rlike(_DOT_SEGMENT), resolved).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen on the page ``base`` (RFC 3986 section 5)."""

    def general(b: Column, h: Column, ref: Column) -> Column:
        joined = let(
            _resolve(b, h), lambda t: _join(*(t[n] for n in ("scheme", "netloc", "path", "params", "query", "fragment")))
        )
        return F.when(_is_relative(b, h), joined).otherwise(ref)

    def either(page: Column, ref: Column) -> Column:
        resolved = let(split_url(page), lambda b: let(split_url(ref), lambda h: general(b, h, ref)))
        return F.when(page == "", ref).when(ref == "", page).otherwise(resolved)

    return let(base, lambda page: let(href, lambda ref: either(page, ref)))


def absolute_parts(base_parts: Column, href: Column) -> Column:
    """Split form of the target of ``href`` on the page whose URL is split in ``base_parts``."""
    return let(
        split_url(href),
        lambda h: F.when(_is_relative(base_parts, h), _resolve(base_parts, h)).otherwise(h),
    )


def _is_relative(b: Column, h: Column) -> Column:
    return ((h["scheme"] == "") | (h["scheme"] == b["scheme"])) & _one_of(b["scheme"], _RELATIVE)


def _resolve(b: Column, h: Column) -> Column:
    """Split form of the target of reference ``h`` on page ``b`` (both split, see ``_is_relative``)."""
    scheme = b["scheme"]
    takes_params, has_netloc = _one_of(scheme, _WITH_PARAMS), _one_of(scheme, _WITH_NETLOC)
    # Without parameters under this scheme the split-off text belongs to the path.
    whole = F.concat(h["path"], F.when(h["params"] != "", F.concat(F.lit(";"), h["params"])).otherwise(""))
    path = F.when(takes_params, h["path"]).otherwise(whole)
    params = F.when(takes_params, h["params"]).otherwise("")

    def resolved(r: Column) -> Column:
        folder = F.when(b["path"] == "", "/").otherwise(
            F.regexp_replace(F.regexp_replace(b["path"], r"[^/]*\z", ""), r"/{2,}", "/")
        )
        merged = F.when(r["path"].startswith("/"), r["path"]).otherwise(
            F.concat(folder, F.regexp_replace(r["path"], r"/{2,}", "/"))
        )
        clean = let(let(merged, _without_dots), lambda p: F.when(p == "", "/").otherwise(p))
        return F.struct(
            scheme.alias("scheme"),
            F.when(r["elsewhere"] | ~has_netloc, h["netloc"]).otherwise(b["netloc"]).alias("netloc"),
            F.when(r["elsewhere"], r["path"]).when(r["same_page"], b["path"]).otherwise(clean).alias("path"),
            F.when(~r["elsewhere"] & r["same_page"], b["params"]).otherwise(r["params"]).alias("params"),
            F.when(~r["elsewhere"] & r["same_page"] & (h["query"] == ""), b["query"]).otherwise(h["query"]).alias("query"),
            h["fragment"].alias("fragment"),
        )

    reference = F.struct(
        path.alias("path"),
        params.alias("params"),
        (has_netloc & (h["netloc"] != "")).alias("elsewhere"),
        ((h["path"] == "") & (h["params"] == "")).alias("same_page"),
    )
    return let(reference, resolved)


def same_site(t: Column, b: Column, include_subdomains: bool | Column) -> Column:
    """Same-site test over split URLs; ports do not count."""
    target, base = host_of(t["netloc"]), host_of(b["netloc"])
    wide = F.lit(include_subdomains) if isinstance(include_subdomains, bool) else include_subdomains
    return (t["scheme"] == b["scheme"]) & (
        (target == base) | (wide & F.endswith(target, F.concat(F.lit("."), base)))
    )


def is_internal(url: Column, base: Column, include_subdomains: bool | Column = False) -> Column:
    """True when ``url`` has the scheme and host of ``base`` (or a host below it)."""
    found = let(
        split_url(url),
        lambda t: let(split_url(base), lambda b: same_site(t, b, include_subdomains)),
    )
    return F.coalesce(found, F.lit(False))


def usable_patterns(patterns: Sequence[str]) -> list[str]:
    """The patterns that compile; the others are skipped."""
    good = []
    for pattern in patterns:
        try:
            re.compile(pattern)
        except re.error:
            continue
        good.append(pattern)
    return good


def path_allowed(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Path filter: any exclude pattern rejects; a non-empty include list needs a match.

    Patterns are searched for anywhere in the path. Use the common subset of Python and Java regular
    expressions. An include list without a single valid pattern rejects everything.
    """
    ok = F.lit(True)
    banned, wanted = usable_patterns(exclude), usable_patterns(include)
    for pattern in banned:
        ok = ok & ~path.rlike(pattern)
    if include:
        hit = F.lit(False)
        for pattern in wanted:
            hit = hit | path.rlike(pattern)
        ok = ok & hit
    return ok


def url_allowed(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Path filter applied to the path part of ``url``."""
    if not include and not exclude:
        return F.lit(True)
    found = let(split_url(url)["path"], lambda path: path_allowed(path, include, exclude))
    return F.coalesce(found, F.lit(False))


def href_followable(href: Column) -> Column:
    """False for empty and fragment-only hrefs and for schemes that are not pages."""
    skipped = "|".join(SKIPPED_SCHEMES)
    return (href != "") & ~href.rlike(rf"(?i)\A(?:#|(?:{skipped}):)")


def seed_url(url: Column) -> Column:
    """Struct of the usable seed URL and the reason why it is rejected (one of both is NULL)."""
    text = strip(url)
    full = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    reason = (
        F.when(is_blank(url), "URL cannot be empty")
        .when(~full.rlike(r"\Ahttps?://"), "URL must start with http:// or https://")
        .when(F.char_length(full) > MAX_URL_CHARS, f"URL too long (max {MAX_URL_CHARS} characters)")
    )
    return F.struct(F.when(reason.isNull(), full).alias("url"), reason.alias("reject_reason"))


def link_target(
    base_parts: Column,
    origin: Column,
    href: Column,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_subdomains: bool = False,
) -> Column:
    """Canonical target of ``href`` on a page, NULL when the link is not to be followed.

    ``base_parts`` is the split page URL and ``origin`` its ``scheme://authority`` in lower case.
    Site-relative plain paths, the bulk of links, skip general resolution.
    """
    plain = href.rlike(_PLAIN_PATH) & (origin != "")
    quick = F.concat(
        origin,
        F.when(
            (F.char_length(href) > 1) & href.endswith("/"), F.regexp_replace(href, r"/++\z", "")
        ).otherwise(href),
    )
    general = let(
        absolute_parts(base_parts, href),
        lambda t: F.when(same_site(t, base_parts, include_subdomains), canonical_text(t, False)),
    )
    target = F.when(~href_followable(href), F.lit(None)).when(plain, quick).otherwise(general)
    if not include and not exclude:
        return target
    return let(target, lambda u: F.when(url_allowed(u, include, exclude), u))

