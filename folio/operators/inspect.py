"""Checks of stored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import patterns as P
from folio.functions.text import UNICODE, matches, ustrip

NEEDED = ["content_type", "has_code", "source"]


def flag_issues(text: Column) -> Column:
    """Array of damage flags in fixed order; a hint each, no verdict."""
    s = ustrip(text)
    first, last = F.substring(s, 1, 1), F.substring(s, -1, 1)
    rows = r"(?m)^\|.*\|$"
    code = F.lit(False)
    for sign in P.CODE_SIGNS:
        code = code | text.contains(sign)
    return F.array_compact(
        F.array(
            F.when(F.regexp_count(text, F.lit("```")) % 2 != 0, "UNBALANCED_CODE_FENCE"),
            F.when((matches(text, rows) > 0) & (F.size(F.filter(F.regexp_extract_all(text, F.lit(UNICODE + rows), F.lit(0)), lambda r: r.rlike(r"^\|[\s\-:|]+\|$"))) == 0), "TABLE_ROWS_NO_SEPARATOR"),
            F.when((first == F.lower(first)) & (first != F.upper(first)), "STARTS_MID_SENTENCE"),
            F.when((F.length(s) > 0) & ~F.lit(P.SENTENCE_ENDS).contains(last), "ENDS_MID_SENTENCE"),
            F.when((F.length(s) > 0) & (F.length(s) < 40), "VERY_SHORT_CHUNK"),
            F.when(code & ~text.contains("```") & ~text.contains("[CODE]"), "POSSIBLE_UNTAGGED_CODE"),
        )
    )


def missing_fields(metadata: Column) -> Column:
    """Which of the needed keys a chunk's metadata map lacks; all for null."""
    need = F.array(*map(F.lit, NEEDED))
    return F.when(metadata.isNull(), need).otherwise(F.array_except(need, F.map_keys(metadata)))


def about(df: DataFrame, needle: str, content: str = "text", source: str = "source") -> DataFrame:
    return df.filter(F.col(source).contains(needle) | F.col(content).contains(needle))
