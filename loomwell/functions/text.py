"""Scalar text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is stripped at the edges of a line, and what counts as a control character.
EDGES = " \t\r\n"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
# What counts as an anomaly. Control characters are those of the Unicode category Cc without tab, line feed,
# carriage return, and without form feed, which is counted by itself.
ANOMALIES = {
    "replacement_characters": "�",
    "cid_codes": r"\(cid:[0-9]+\)",
    "glyph_names": r"/H[0-9]+",
    "form_feeds": r"\x0c",
    "control_characters": r"[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f]",
}


def edge_trim(c: Column) -> Column:
    """Strip spaces, tabs, carriage returns and line feeds only; other control characters stay."""
    return F.btrim(c, F.lit(EDGES))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the edges."""
    return F.btrim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "), F.lit(" "))


def has_control(c: Column) -> Column:
    """Holds a control character other than tab, line feed and carriage return."""
    return c.rlike(CONTROLS)


def word_count(c: Column) -> Column:
    """Runs of characters that are no white space; 0 for a blank text."""
    return F.regexp_count(c, F.lit(r"\S+"))


def char_count(c: Column) -> Column:
    """Length in code points."""
    return F.char_length(c)


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def pair_id(*parts: Column) -> Column:
    """Identity of a judged pair: SHA-256 over the parts joined by NUL."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def response_id(*parts: Column) -> Column:
    """Identity of a response: SHA-256 over the parts joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def anomalies(c: Column) -> dict[str, Column]:
    """Counts of what extraction leaves behind when it fails."""
    return {name: F.regexp_count(c, F.lit(pattern)) for name, pattern in ANOMALIES.items()}


def full_match(c: Column, pattern: str) -> Column:
    """The whole value matches; a line feed at the end is no exception."""
    return c.rlike(rf"\A(?:{pattern})\z")


def expected_page_label(page: Column, offset: int) -> Column:
    return (page - offset).cast("string")


def protect_newlines(c: Column) -> Column:
    """Line feeds become U+E000; as long as before, and undone by ``restore_newlines``."""
    return F.replace(c, F.lit("\n"), F.lit("\ue000"))


def restore_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\ue000"), F.lit("\n"))


def table_count(doc: Column, label: str, part: int) -> Column:
    """The count (part 1) or total (part 2) of the row ``| label | n / total |`` of a Markdown table; null if it is missing."""
    import re

    found = F.regexp_extract(doc, rf"(?m)^\|\s*{re.escape(label)}\s*\|\s*(\d+)\s*/\s*(\d+)", part)
    return F.when(found != "", found.cast("long"))
