"""Text tests that stay in Catalyst: ASCII, UTF-8 with a cut tail, and "looks like text"."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import BOMS, TEXT_MIN_FRACTION, TEXT_SCALARS

_NON_TEXT_CONTROLS = r"[\p{Cc}&&[^\r\n\t]]"
_CONT = "(?:8|9|A|B)[0-9A-F]"
# A valid but unfinished UTF-8 sequence at the end of an upper-case hex string, by bytes present.
_TAIL_3 = f"(?:F0(?:9|A|B)[0-9A-F]|F[123]{_CONT}|F48[0-9A-F]){_CONT}$"
_TAIL_2 = (
    f"(?:E0(?:A|B)[0-9A-F]|E[1-9ABCEF]{_CONT}|ED(?:8|9)[0-9A-F]"
    f"|F0(?:9|A|B)[0-9A-F]|F[123]{_CONT}|F48[0-9A-F])$"
)
_TAIL_1 = "(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F]|F[0-4])$"


def printable_fraction(text: Column) -> Column:
    """Share of the first 500 scalars that are not controls (CR, LF and TAB are text)."""
    head = F.substring(text, 1, TEXT_SCALARS)
    n = F.char_length(head)
    return F.when(n > 0, (n - F.regexp_count(head, F.lit(_NON_TEXT_CONTROLS))) / n)


def looks_like_text(text: Column) -> Column:
    """No private-use scalar among the first 500, and at least 90 % of them printable."""
    head = F.substring(text, 1, TEXT_SCALARS)
    ok = ~head.rlike(r"\p{Co}") & (printable_fraction(text) >= TEXT_MIN_FRACTION)
    return F.coalesce(ok, F.lit(False))


def is_ascii_text(sample: Column) -> Column:
    """Only TAB, LF, CR and 20-7E. Any byte above 7F shows up as a non-ASCII character."""
    return ~sample.cast("string").rlike(r"[^\t\n\r -~]")


def without_cut_utf8_tail(sample: Column) -> Column:
    """Drop a valid but unfinished UTF-8 sequence (up to 3 bytes) from the end."""
    n = F.length(sample)
    tail = F.hex(F.when(n > 3, F.substring(sample, -3, 3)).otherwise(sample))
    cut = (
        F.when(tail.rlike(_TAIL_1), 1)
        .when(tail.rlike(_TAIL_2), 2)
        .when(tail.rlike(_TAIL_3), 3)
        .otherwise(0)
    )
    return F.substring(sample, F.lit(1), n - cut)


def is_utf8(sample: Column, cut_tail: bool = True) -> Column:
    body = without_cut_utf8_tail(sample) if cut_tail else sample
    return F.is_valid_utf8(body.cast("string"))


def utf8_head(sample: Column) -> Column:
    """First 500 scalars when the sample (less a cut tail) is valid UTF-8, else NULL."""
    text = without_cut_utf8_tail(sample).cast("string")
    return F.when(F.is_valid_utf8(text), F.substring(text, 1, TEXT_SCALARS))


def bom_charset(content: Column) -> Column:
    """Charset named by a leading byte-order mark, longest mark first; NULL when there is none."""
    c = None
    for charset, mark in BOMS:
        hit = F.startswith(content, F.lit(bytes.fromhex(mark)))
        c = F.when(hit, charset) if c is None else c.when(hit, charset)
    return c
