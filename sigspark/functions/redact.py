"""Masking of credentials and numbers. Whole texts, native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headers whose value is an address of a party, long and compact names.
PARTY_HEADERS = [
    "from", "to", "p-asserted-identity", "p-preferred-identity", "remote-party-id", "contact",
    "history-info", "diversion", "refer-to", "referred-by", "f", "t", "m", "c",
]
ELLIPSIS = "…"


def redact_credentials(text: Column) -> Column:
    """Blank digest responses and client nonces wherever they stand."""
    out = F.regexp_replace(text, r'(?i)(response\s*=\s*")[^"]*(")', "$1REDACTED$2")
    return F.regexp_replace(out, r'(?i)(cnonce\s*=\s*")[^"]*(")', "$1REDACTED$2")


def redact_secrets(text: Column) -> Column:
    """Blank the value of key=value or key: value secrets in free text."""
    return F.regexp_replace(
        text,
        r"(?i)\b(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)\S+",
        "$1$2REDACTED",
    )


def mask_digits(text: Column) -> Column:
    """Keep the first four and the last two digits of every run of eight or more."""
    return F.regexp_replace(text, r"(\+?\d{4})\d{2,}(\d{2})", "$1" + ELLIPSIS + "$2")


def mask_uris(text: Column) -> Column:
    """Mask the number of each sip:, sips: or tel: URI, however long, leaving other digits alone.

    The text is cut before each scheme; what follows one up to the first sign that no number has is masked.
    """
    number = r"(?i)^((?:sips?|tel):[+\d\-.()\s]*)"

    def masked(piece: Column) -> Column:
        head = F.regexp_extract(piece, number, 1)
        return F.concat(mask_digits(head), F.substring(piece, F.length(head) + 1, F.length(piece)))

    return F.array_join(F.transform(F.split(text, r"(?i)(?<![A-Za-z0-9_])(?=(?:sips?|tel):)", -1), masked), "")


def redact_headers(headers: Column) -> Column:
    """``ARRAY<STRUCT<name,value>>`` with digest credentials blanked."""
    return F.transform(
        headers, lambda h: F.struct(h["name"].alias("name"), redact_credentials(h["value"]).alias("value"))
    )


def mask_headers(headers: Column) -> Column:
    """Party headers masked wherever digits stand, others in URIs only."""
    return F.transform(
        headers,
        lambda h: F.struct(
            h["name"].alias("name"),
            F.when(F.lower(h["name"]).isin(PARTY_HEADERS), mask_digits(h["value"]))
            .otherwise(mask_uris(h["value"]))
            .alias("value"),
        ),
    )


def mask_user(user: Column) -> Column:
    """Mask a bare user part when it is number-shaped."""
    return F.when(user.rlike(r"^\+?[\d\-.()\s]{7,}$"), mask_digits(user)).otherwise(user)
