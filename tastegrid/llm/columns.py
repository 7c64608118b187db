"""Small column expressions that several operators share."""

import string

from pyspark.sql import Column, functions as F

# A word of the size and shingle rules: anything between ASCII white space.
SPACE = r"\x20\x09-\x0D"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the fold a labelled row belongs to."""
    return F.crc32(doc_id.cast("string")) % divisor
