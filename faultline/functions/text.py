"""Text expressions: decoding, stripping, title case, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A quoted literal of four or more characters, as the credential rules see it.
QUOTED_VALUE = r"""['"]([^'"\n]{4,})['"]"""


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def decode_text(data: Column) -> Column:
    """Bytes as UTF-8 text: invalid bytes dropped, line ends made ``\\n``."""
    raw = data.cast("string")
    dropped = F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit(""))
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(dropped)
    return F.regexp_replace(text, "\r\n?", "\n")


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def mask(secret: Column) -> Column:
    """First and last four characters with stars between; short values all stars."""
    size = F.length(secret)
    shown = F.concat(
        F.substring(secret, 1, 4), F.repeat(F.lit("*"), size - 8), F.right(secret, F.lit(4)))
    return F.when(size <= 8, F.repeat(F.lit("*"), size)).otherwise(shown)


def mask_values(text: Column, value_regex: str, group: int) -> Column:
    """``text`` with every value captured by ``value_regex`` masked."""
    values = F.regexp_extract_all(text, F.lit(value_regex), F.lit(group))
    return F.aggregate(values, text, lambda done, value: F.replace(done, value, mask(value)))
