"""Text expressions: white space, tokens, truncation, cleaning and answer extraction.

White space and word characters follow the Unicode rules of a general-purpose language rather
than ASCII: combining marks end a word, and no-break and other spaces separate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that splitting and stripping use.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = f"[^{WS[1:]}"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(column(c), rf"\A{WS}+|{WS}+\z", "")


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space only: stops at the first other sign, however long the text."""
    c = column(c)
    return c.isNull() | ~F.rlike(c, F.lit(NOT_WS))


def word_tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, numbers and underscores; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(column(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array().cast("array<string>"))


def space_tokens(c: Column | str) -> Column:
    """Runs without white space, case kept; null has none."""
    return F.coalesce(F.array_remove(F.split(column(c), f"{WS}+"), ""), F.array().cast("array<string>"))


def first_tokens(c: Column | str, n: int) -> Column:
    """The rest of the text is not split: a piece before the first white space may be empty, and one
    more holds the rest."""
    return F.array_join(F.slice(F.coalesce(F.array_remove(F.split(column(c), f"{WS}+", n + 2), ""), F.array().cast("array<string>")), 1, n), " ")


def truncate(c: Column | str, n: int = 500) -> Column:
    """At most ``n`` code points, with an ellipsis if that cuts."""
    c = column(c)
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def without_leading_number(c: Column | str) -> Column:
    return F.regexp_replace(column(c), rf"\A\p{{Nd}}+{WS}+", "")


def as_text(c: Column | str) -> Column:
    """Null as the word None, which ROUGE inputs are given for parity."""
    return F.coalesce(column(c).cast("string"), F.lit("None"))


def usable(*references: Column | str) -> Column:
    """The references that are neither null nor blank, in order."""
    return F.filter(F.array(*[column(c) for c in references]), lambda x: ~is_blank(x))


def extract(response: Column | str, marker: str, mode: str) -> Column:
    """The answer after ``marker`` in a response; without one, the stripped response; null is ''.

    ``first_line`` takes the rest of the first line with text, as it stands; ``to_end`` all that
    follows, stripped; ``paragraph`` up to a blank line, stripped, in any case of the marker.
    """
    c, m = column(response), "".join(f"\\{x}" if not x.isalnum() and not x.isspace() else x for x in marker)
    pattern = {"first_line": rf"(?d){m}{WS}*(.*)", "to_end": rf"(?s){m}{WS}*(.*)", "paragraph": rf"(?is){m}{WS}*(.*?)(?:\n\n|\z)"}[mode]
    got = F.regexp_extract(c, pattern, 1)
    return F.when(c.isNull(), "").when(F.regexp_like(c, F.lit(pattern)), got if mode == "first_line" else strip(got)).otherwise(strip(c))
