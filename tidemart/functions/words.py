"""Keyword splitting with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A run of Han characters, or a run of any other letters and digits.
RUN_PATTERN = r"(\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+)"
HAN_PATTERN = r"^\p{IsHan}{2,}$"
HAN_PAIR = r"\p{IsHan}{2}"


def words(text: Column) -> Column:
    """Lower-cased words of a text as an array.

    Alphabetic and digit runs are words as they stand. Scripts written without blanks have no
    word boundary to split at, so a Han run gives its overlapping two-character pieces: every
    character takes part in more than one piece, which is the fine-grained splitting the keyword
    summary expects.
    """
    lowered = F.lower(text)
    runs = F.regexp_extract_all(lowered, F.lit(RUN_PATTERN), F.lit(1))

    def pieces(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))),
                            lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(HAN_PATTERN), pairs).otherwise(F.array(run))

    # runs are looked at one by one only in a text that has something to cut
    return F.when(lowered.rlike(HAN_PAIR), F.flatten(F.transform(runs, pieces))).otherwise(runs)
