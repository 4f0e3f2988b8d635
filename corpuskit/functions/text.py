"""Text quality expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: C0 controls without tab, newline and carriage return, plus DEL.
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

# Upper bounds (inclusive) and labels of the length buckets.
LENGTH_BUCKETS = [(1_000, "<=1k"), (10_000, "1k-10k"), (100_000, "10k-100k")]
LONGEST_BUCKET = ">100k"
NULL_BUCKET = "null"

# Fixed value: the address form the sign-up page accepts. ``\z`` because Java's ``$``
# would also match before a trailing newline.
EMAIL = r"^[a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,4}\z"


def is_nullish(c: Column) -> Column:
    """Null or empty; whitespace counts as text. Never null itself."""
    return c.isNull() | (F.octet_length(c) == 0)  # unlike length, does not walk the text


def all_nullish(columns: list[Column]) -> Column:
    """True where every one of the columns is nullish."""
    return reduce(and_, [is_nullish(c) for c in columns])


def text_length(c: Column, null_as: int | None = None) -> Column:
    """Length in characters; null stays null unless ``null_as`` is given."""
    length = F.length(c)
    return length if null_as is None else F.coalesce(length, F.lit(null_as))


def length_bucket(length: Column, strict: bool = False) -> Column:
    """Label of the size class of a length.

    Null lengths get their own label; ``strict=True`` files them under the longest
    class, as a plain if-else chain does.
    """
    cases = [(length <= bound, F.lit(label)) for bound, label in LENGTH_BUCKETS]
    if not strict:
        cases.insert(0, (length.isNull(), F.lit(NULL_BUCKET)))
    chain = F.when(*cases[0])
    for case in cases[1:]:
        chain = chain.when(*case)
    return chain.otherwise(F.lit(LONGEST_BUCKET))


def has_control_chars(c: Column) -> Column:
    return c.rlike(CONTROL_CHARS)


def snippet(c: Column, n: int = 200) -> Column:
    """First line, cut to ``n`` characters with an ellipsis when longer."""
    line = F.regexp_extract(c, "(.*)", 0)
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)


def strip(c: Column) -> Column:
    """Whitespace of every kind off both ends; ``trim`` takes off blanks only."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def slug(c: Column) -> Column:
    """ASCII letters and digits, the rest folded to single underscores; ``blank`` if none is left."""
    folded = F.regexp_replace(c, "[^0-9A-Za-z]+", "_")
    trimmed = F.trim(folded, F.lit("_"))
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("blank"))


def normalise_list(c: Column) -> Column:
    """Comma list to an array of trimmed upper-case names, blanks dropped."""
    parts = F.transform(F.split(c, ","), lambda p: F.upper(strip(p)))
    return F.filter(parts, lambda p: p != "")


def is_valid_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def flatten_lines(c: Column) -> Column:
    """Newlines to spaces, one for one."""
    return F.translate(c, "\n", " ")


def restore_breaks(translated: Column, original: Column) -> Column:
    """Turn the first N spaces into newlines, N being the newlines of the original."""
    breaks = F.length(original) - F.length(F.translate(original, "\n", ""))
    return F.array_join(F.split(translated, " ", breaks + 1), "\n")
