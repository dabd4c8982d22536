"""PRJ-1 truncate_args, PRJ-2 cap_text, PRJ-6 timeline summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARG_CAP = 2048          # string args longer than this are replaced by a length marker
TEXT_CAP, TEXT_KEEP = 8192, 8000
STREAM_CAP = 8000       # stdout/stderr: threshold and kept length are equal
SUMMARY_CHARS = 120


def truncate_value(v: Column, cap: int = ARG_CAP) -> Column:
    return F.when(F.length(v) > cap, F.concat(F.lit("<truncated, "), F.length(v).cast("string"),
                                              F.lit(" chars>"))).otherwise(v)


def truncate_args(m: Column, cap: int = ARG_CAP) -> Column:
    """Shallow: every string value of a map longer than ``cap`` becomes a length marker."""
    return F.transform_values(m, lambda _k, v: truncate_value(v, cap))


def cap_text(c: Column, cap: int = TEXT_CAP, keep: int = TEXT_KEEP) -> Column:
    """Keep ``keep`` leading chars of a text longer than ``cap`` plus a marker of what was cut."""
    return F.when(F.length(c) > cap, F.concat(
        F.substring(c, 1, keep), F.lit("\n\n[truncated, "),
        (F.length(c) - keep).cast("string"), F.lit(" more chars]"))).otherwise(c)


def cap_stream(c: Column) -> Column:
    return cap_text(c, STREAM_CAP, STREAM_CAP)


def timeline_summary(result_summary: Column, error: Column, n: int = SUMMARY_CHARS) -> Column:
    """First ``n`` chars of the result, else the error, else ''; an empty result falls through."""
    return F.substring(F.coalesce(F.nullif(result_summary, F.lit("")), error, F.lit("")), 1, n)
