"""PRJ-5 args_signature, PRJ-7 redact_map (map<string,string> expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key pattern (matched on the upper-cased key) whose values are redacted;
# PAT only counts at a token boundary so PATH is kept and GH_PAT is not.
REDACT_PATTERN = (r"(KEY|TOKEN|SECRET|PASSWORD|PASSWD|AUTH|BEARER|COOKIE|CREDENTIAL|PRIVATE)"
                  r"|(?:^|_)PAT(?:_|$)")
REDACTED = "<redacted>"


def args_map(args_json: Column) -> Column:
    """JSON object text → map<string,string> (nested values kept as raw JSON text)."""
    return F.from_json(args_json, "map<string,string>")


def canonical_args(args_json: Column) -> Column:
    """Key-sorted JSON of an args object: equal objects give equal strings whatever the key
    order; missing args → ``{}``."""
    m = F.coalesce(args_map(args_json), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def args_signature(tool: Column, args_json: Column) -> Column:
    """(tool, canonical args) — missing tool → ''."""
    return F.struct(F.coalesce(tool, F.lit("")).alias("tool"), canonical_args(args_json).alias("args"))


def is_secret_key(key: Column) -> Column:
    return F.upper(key).rlike(REDACT_PATTERN)


def redact_map(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: F.when(is_secret_key(k), F.lit(REDACTED)).otherwise(v))
