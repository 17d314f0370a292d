"""Host columns: domain allow/block rules and the private-address gate."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip
from .urls import host_of, split_url, url_host

# Address ranges that must not be fetched.
BLOCKED_NETWORKS = (
    "127.0.0.0/8",
    "::1/128",
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "fc00::/7",
    "fe80::/10",
    "169.254.0.0/16",
    "224.0.0.0/4",
    "ff00::/8",
    "0.0.0.0/8",
    "192.0.2.0/24",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "100.64.0.0/10",
    "198.18.0.0/15",
)

# Host names that must not be fetched.
BLOCKED_HOSTS = (
    "localhost",
    "127.0.0.1",
    "0.0.0.0",
    "::1",
    "[::1]",
    "metadata.google.internal",
)

# Video, image and media sites that hold no text to research.
MEDIA_DOMAINS = (
    "youtube.com",
    "www.youtube.com",
    "youtu.be",
    "m.youtube.com",
    "vimeo.com",
    "www.vimeo.com",
    "dailymotion.com",
    "www.dailymotion.com",
    "tiktok.com",
    "www.tiktok.com",
    "instagram.com",
    "www.instagram.com",
    "twitch.tv",
    "www.twitch.tv",
    "bilibili.com",
    "www.bilibili.com",
    "rumble.com",
    "www.rumble.com",
    "odysee.com",
    "www.odysee.com",
)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEXTET = r"[0-9a-fA-F]{1,4}"


def clean_domain(domain: Column) -> Column:
    """Rule entry as it is compared: trimmed, lower case, no leading dots."""
    return F.regexp_replace(F.lower(strip(domain)), r"\A\.+", "")


def merge_rules(*lists: Iterable[str]) -> list[str]:
    """Union of rule lists: trimmed, lower case, blanks dropped, first occurrence kept."""
    merged = (entry.strip().lower() for rules in lists for entry in rules if entry)
    return list(dict.fromkeys(entry for entry in merged if entry))


def host_matches(host: Column, domains: Iterable[str]) -> Column:
    """True when the host equals or lies below one of the domains (literal list)."""
    names = [d for d in (entry.strip().lower().lstrip(".") for entry in domains) if d]
    if not names:
        return F.lit(False)
    choice = "|".join(rf"\Q{name}\E" for name in names)
    return host.rlike(rf"(?:\A|\.)(?:{choice})\z")


def domain_allowed(url: Column, allow: Iterable[str] = (), block: Iterable[str] = ()) -> Column:
    """Domain rules: block wins, an empty allow list allows all, a URL without host is rejected."""
    allow, block = list(allow), list(block)

    def passes(host: Column) -> Column:
        ok = (host != "") & ~host_matches(host, block)
        return ok & host_matches(host, allow) if allow else ok

    return F.coalesce(let(url_host(url), passes), F.lit(False))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``: turns suffix rules into equality."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def is_ipv4(host: Column) -> Column:
    return host.rlike(rf"\A{_IPV4}\z")


def ipv4_number(host: Column) -> Column:
    """Dotted quad as BIGINT, NULL for anything else."""
    quad = F.split(F.when(is_ipv4(host), host), r"\.")
    return (
        F.get(quad, F.lit(0)).cast("bigint") * 16777216
        + F.get(quad, F.lit(1)).cast("bigint") * 65536
        + F.get(quad, F.lit(2)).cast("bigint") * 256
        + F.get(quad, F.lit(3)).cast("bigint")
    )


def is_ipv6(host: Column) -> Column:
    """Literal IPv6 address, zone id allowed."""
    bare = F.regexp_replace(host, r"%[^%]+\z", "")
    plain = F.regexp_replace(bare, rf":{_IPV4}\z", ":0:0")
    full = plain.rlike(rf"\A{_HEXTET}(?::{_HEXTET}){{7}}\z")
    short = (
        plain.rlike(rf"\A(?:{_HEXTET}(?::{_HEXTET})*)?::(?:{_HEXTET}(?::{_HEXTET})*)?\z")
        & (F.regexp_count(plain, F.lit(_HEXTET)) <= 7)
    )
    return full | short


def _in_ipv4_networks(number: Column) -> Column:
    hit = F.lit(False)
    for text in BLOCKED_NETWORKS:
        net = ipaddress.ip_network(text)
        if net.version == 4:
            low, high = int(net.network_address), int(net.broadcast_address)
            hit = hit | number.between(low, high)
    return hit


def _in_ipv6_networks(host: Column) -> Column:
    first = F.conv(
        F.when(host.startswith("::"), "0").otherwise(F.regexp_extract(host, rf"\A({_HEXTET}):", 1)), 16, 10
    ).try_cast("int")
    hit = host.rlike(r"\A[0:]*:0{0,3}1(?:%.*)?\z|\A[0:]*:0\.0\.0\.1(?:%.*)?\z")
    for text in BLOCKED_NETWORKS:
        net = ipaddress.ip_network(text)
        if net.version == 6 and net.prefixlen <= 16:
            low = int(net.network_address) >> 112
            high = int(net.broadcast_address) >> 112
            hit = hit | first.between(low, high)
    return hit


def is_blocked_address(address: Column, block_mapped: bool = False) -> Column:
    """True for a literal IP address inside a blocked range, False for anything else.

    IPv4 addresses mapped into IPv6 count as IPv6 unless ``block_mapped``.
    """
    number = ipv4_number(address)
    if block_mapped:
        inner = F.regexp_extract(address, rf"(?i)\A(?:0*:)*ffff:({_IPV4})\z", 1)
        number = F.coalesce(number, ipv4_number(inner))
    in_v4 = F.coalesce(let(number, _in_ipv4_networks), F.lit(False))
    in_v6 = F.coalesce(is_ipv6(address) & _in_ipv6_networks(address), F.lit(False))
    return F.when(F.contains(address, F.lit(":")), in_v6 | (in_v4 if block_mapped else F.lit(False))).otherwise(in_v4)


def is_private_host(host: Column, block_mapped: bool = False) -> Column:
    """True for an empty host, a blocked name or a literal address in a blocked range."""
    bare = F.regexp_replace(host, r"\A[\[\]]+|[\[\]]+\z", "")
    blocked = let(
        bare, lambda h: F.lower(h).isin(*BLOCKED_HOSTS) | is_blocked_address(h, block_mapped)
    )
    return F.coalesce((host == "") | blocked, F.lit(True))


def is_safe_url(url: Column, block_mapped: bool = False) -> Column:
    """True when the URL may be fetched as far as its text tells (names are checked by a DNS join)."""
    parts = split_url(strip(url))
    ok = let(
        parts,
        lambda p: p["scheme"].isin("http", "https")
        & let(host_of(p["netloc"]), lambda h: ~is_private_host(h, block_mapped)),
    )
    return F.coalesce(ok, F.lit(False))
