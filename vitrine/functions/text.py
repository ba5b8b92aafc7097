"""Scalar text cleaning as JVM expressions (O-21 to O-25, O-28, O-52).

Python's ``\\s`` also covers the four ASCII separators 0x1C-0x1F, which Java's Unicode
white-space class leaves out, so ``SPACE`` names both. ``WHITE_SPACE`` lists the characters.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\x1c-\x1f]"
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(col: Column) -> Column:
    """O-24: remove Unicode white space from both ends (plain ``trim`` removes only spaces).

    A character set, not a pattern: a pattern anchored at the end takes quadratic time on
    long runs of white space inside the text.
    """
    return F.btrim(col, F.lit(WHITE_SPACE))


def text_lines(col: Column) -> Column:
    """O-24: split into lines, strip each one and drop the blank ones."""
    lines = F.split(col, r"\R|[\x1c-\x1e]")
    return F.filter(F.transform(lines, strip), lambda line: line != "")


def year_or_self(col: Column) -> Column:
    """O-21: the first run of four digits, or the value itself when there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(col, r"(?U)\d{4}", 0), F.lit("")), col)


def abbreviate(
    col: Column,
    pattern: str = rf"(?U)Limited Edition{SPACE}+",
    replacement: str = "LE ",
) -> Column:
    """O-22: replace every match of a phrase by its short form."""
    return F.regexp_replace(col, pattern, replacement)


@F.arrow_udf(T.StringType())
def _nfkd_ascii(values: pa.Array) -> pa.Array:
    decomposed = pc.utf8_normalize(values, form="NFKD")
    return pc.replace_substring_regex(decomposed, pattern=r"[^\x00-\x7F]", replacement="")


def ascii_id(col: Column) -> Column:
    """O-23: compatibility decomposition, then drop whatever is not ASCII.

    Spark has no normalisation function, so this is one vectorised Arrow call. Pure
    ASCII values are handed over as NULL and never leave the JVM.
    """
    return F.coalesce(_nfkd_ascii(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def basename(col: Column) -> Column:
    """O-25: everything after the last slash, query string included."""
    return F.substring_index(col, "/", -1)


def coalesce_text(col: Column) -> Column:
    """O-28: an absent or null text becomes the empty string."""
    return F.coalesce(col, F.lit(""))


def price_or_null(col: Column) -> Column:
    """O-52: first decimal number in a free-text price, else NULL."""
    digits = F.nullif(F.regexp_extract(col, r"(\d+(?:\.\d+)?)", 1), F.lit(""))
    return digits.try_cast("double")
