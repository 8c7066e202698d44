"""Addresses: classification, extraction, coarsening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4_TEXT = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
IPV4_WHOLE = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def _octet(ip: Column, i: int) -> Column:
    return F.split_part(ip, F.lit("."), F.lit(i)).try_cast("int")


def is_private_ip(ip: Column) -> Column:
    """RFC 1918 and RFC 6598 IPv4 addresses; false for anything that is not a valid IPv4 address."""
    a, b, c, d = (_octet(ip, i) for i in (1, 2, 3, 4))
    valid = ip.rlike(IPV4_WHOLE) & (a <= 255) & (b <= 255) & (c <= 255) & (d <= 255)
    private = (
        (a == 10)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 100) & b.between(64, 127))
    )
    return F.coalesce(valid & private, F.lit(False))


def address_class(ip: Column) -> Column:
    """documentation, private, cgnat, v6, public or unknown."""
    a, b, c = (_octet(ip, i) for i in (1, 2, 3))
    v4 = F.coalesce(ip.rlike(IPV4_WHOLE), F.lit(False))
    doc = (
        ((a == 192) & (b == 0) & (c == 2))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    doc6 = F.lower(ip).startswith("2001:db8:")
    return (
        F.when(ip.isNull() | (ip == ""), "unknown")
        .when((v4 & doc) | doc6, "documentation")
        .when(v4 & (a == 100) & b.between(64, 127), "cgnat")
        .when(is_private_ip(ip), "private")
        .when(v4 & (a <= 255), "public")
        .when(ip.contains(":"), "v6")
        .otherwise("unknown")
    )


def ips_in(text: Column, private_only: bool = False) -> Column:
    """Distinct IPv4 addresses anywhere in a text, in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(IPV4_TEXT), F.lit(1)))
    return F.filter(found, is_private_ip) if private_only else found


def coarsen_ip(ip: Column) -> Column:
    """/24 for IPv4 (also mapped into IPv6), three groups for IPv6, '-' for nothing."""
    mapped = F.regexp_extract(ip, r"(\d+\.\d+\.\d+)\.\d+$", 1)
    groups = F.concat(
        F.array_join(F.slice(F.split(ip, ":"), 1, 3), ":"), F.lit("::")
    )
    return (
        F.when(ip.isNull() | (ip == ""), "-")
        .when(ip.contains(":") & (mapped != ""), F.concat(mapped, F.lit(".0")))
        .when(ip.contains(":"), groups)
        .when(ip.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.concat(mapped, F.lit(".0")))
        .otherwise(ip)
    )


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, empty when there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
