"""Word and character patterns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the contract: white space that separates words, and what separates index words (in folded text, and in any).
SPACE = r"[\x20\x09-\x0D]+"
INDEX_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_INDEX_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def count_pieces(text: Column, gap: str) -> Column:
    """Number of pieces of ``text`` between ``gap``s (a pattern that matches whole runs); 0 for null. Splitting is far cheaper than matching words."""
    pieces = F.split(text, gap)
    ends = F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) + F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)
    return F.coalesce(F.greatest(F.size(pieces) - ends, F.lit(0)), F.lit(0)).cast("long")


def count_words(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(count_pieces(text, SPACE))
