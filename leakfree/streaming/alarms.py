"""STR-1..6: incremental versions of the log analytics.

STR-2 and STR-6 are aggregates that don't depend on order.  STR-4 keeps the last ``window``
records of each key by ``seq``, in whatever order they arrive.  STR-3 and STR-5 depend on the order of all
rows and run as late folds (``late.py``): a row that arrives behind its key's last ``seq`` takes its
place and what follows it is folded again.  After ``availableNow`` every result equals its batch twin,
however the rows were spread over micro-batches; replayed rows count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leakfree.functions.maps import canonical_args
from leakfree.operators.gate import classify_submissions, gate_state
from leakfree.operators.journal import TOOL_KINDS
from leakfree.operators.ledger import budget_state
from leakfree.sources.io import CORRUPT
from leakfree.streaming.late import LAST, LateFold

COMP = "competition"


def tail_log(lines: DataFrame, schema) -> tuple[DataFrame, DataFrame]:
    """STR-1: parse a streaming text source of JSON lines into records and quarantine."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    raw = lines.where(F.trim("value") != "").select("value", F.from_json(
        "value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad_line = F.col(f"r.{CORRUPT}").isNotNull() | F.col("r").isNull()
    good = raw.where(~bad_line).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    bad = raw.where(bad_line).select(F.col("value").alias(CORRUPT))
    return good, bad


def running_spend(ledger_stream: DataFrame) -> DataFrame:
    """STR-2: spend per competition (update mode)."""
    return ledger_stream.groupBy(COMP).agg(F.sum(F.coalesce(F.col("cost_usd"), F.lit(0.0))).alias("total_usd"))


def behaviour_counters(journal_stream: DataFrame) -> DataFrame:
    """STR-6: tool calls and errors per competition (update mode)."""
    return journal_stream.groupBy(COMP).agg(
        F.count_if(F.col("kind").isin(*TOOL_KINDS)).alias("turns_per_run"),
        F.count_if(F.col("kind") == "tool_error").alias("error_count"))


# ---------------------------------------------------------------- STR-3 budget alarm
def budget_alarm(rows: T.StructType, budget: float, retain: int | None = None) -> Callable[[SparkSession, str], LateFold]:
    """STR-3: approve-and-double budget per competition; ``rows`` is the stream's schema (competition, seq, cost_usd).
    State: ``spent, doublings, breach_seq``."""
    comp = T.StructField(COMP, rows[COMP].dataType)
    state = T.StructType([comp, T.StructField("spent", T.DoubleType()), T.StructField("doublings", T.LongType()),
                          T.StructField("breach_seq", T.LongType()), T.StructField(LAST, T.LongType())])

    def advance(new: DataFrame, carry: DataFrame, n: int) -> tuple[DataFrame, None]:
        return budget_state(new, budget, carry, total_rows=n), None  # the state is the result

    return lambda spark, path: LateFold(spark, path, rows, state, None, advance, [COMP], retain)


def budget_alarms(fold: LateFold, budget: float) -> DataFrame:
    return fold.states().withColumn("final_budget", F.lit(budget) * F.pow(F.lit(2.0), F.col("doublings")))


# ---------------------------------------------------------------- STR-4 stuck loop
def stuck_loop_alarm(journal_stream: DataFrame, window: int = 10, threshold: int = 5) -> DataFrame:
    """STR-4: keyed state = the last ``window`` records (kind flag, tool, canonical args)."""
    comp = journal_stream.schema[COMP].dataType.simpleString()
    out_schema = f"{COMP} {comp}, tool string, args string, repeats long, window int, stuck boolean"
    names = [COMP, "tool", "args", "repeats", "window", "stuck"]
    state_schema = "seqs array<long>, tools array<string>, args array<string>"
    # few columns and plain arrays: most of a step's time goes into its frames.  A record that is no tool call has no tool
    src = journal_stream.select(COMP, "seq", F.when(F.col("kind").isin(*TOOL_KINDS), F.coalesce("tool", F.lit(""))).alias("tool"),
                                canonical_args(F.col("args")).alias("sig"))

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # the last records by seq don't depend on the order of arrival: a late row takes its place, a replay is known
        ring = {r[0]: r for r in zip(*state.get)} if state.exists else {}
        for pdf in pdfs:
            seqs, tools, args = (pdf[c].to_numpy() for c in ("seq", "tool", "sig"))
            for i in np.argsort(-seqs, kind="stable")[:window]:
                ring.setdefault(int(seqs[i]), (int(seqs[i]), tools[i], args[i]))
            ring = {seq: ring[seq] for seq in sorted(ring)[-window:]}
        ring = list(ring.values())
        state.update(tuple([r[i] for r in ring] for i in range(3)))
        sigs = Counter()
        first: dict = {}
        for seq, tool, sig in ring:
            if tool is not None:
                sigs[(tool, sig)] += 1
                first.setdefault((tool, sig), seq)
        # no tool record in the window any more: retract the earlier alarm row
        (tool, sig), cnt = max(sigs.items(), key=lambda kv: (kv[1], -first[kv[0]])) if sigs else ((None, None), 0)
        yield pd.DataFrame([(key[0], tool, sig, cnt, window, cnt >= threshold and cnt > 0)], columns=names)

    return src.groupBy(COMP).applyInPandasWithState(step, out_schema, state_schema, "update",
                                                    GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- STR-5 submission gate
def submission_gate(rows: T.StructType, retain: int | None = None) -> Callable[[SparkSession, str], LateFold]:
    """STR-5: classify each leaderboard record against those before it by ``seq``; ``rows`` is the stream's schema
    (competition, seq, cv_at_submit, metric).  State: ``n_prior, n_num, mx, mn``; output: a row per record."""
    comp = T.StructField(COMP, rows[COMP].dataType)
    state = T.StructType([comp, *[T.StructField(c, T.LongType()) for c in ("n_prior", "n_num", LAST)],
                          *[T.StructField(c, T.DoubleType()) for c in ("mx", "mn")]])
    output = T.StructType([comp, T.StructField("seq", T.LongType()), T.StructField("trigger", T.StringType()),
                           T.StructField("prev_best", T.DoubleType())])

    def advance(new: DataFrame, carry: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        return gate_state(new, carry), classify_submissions(new, carry=carry, total_rows=n)

    return lambda spark, path: LateFold(spark, path, rows, state, output, advance, [COMP], retain)


# ---------------------------------------------------------------- OPT-5 spend per day
def daily_spend(ledger_stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """OPT-5 on a stream: spend per competition and UTC day, each day's sum appended once the watermark (the
    largest ``ts`` less ``delay``) has passed its end; state holds the open days only."""
    day = F.window("ts", "1 day")
    return (ledger_stream.withWatermark("ts", delay).groupBy(COMP, day.alias("day"))
            .agg(F.sum(F.coalesce(F.col("cost_usd"), F.lit(0.0))).alias("cost_usd"), F.count(F.lit(1)).alias("n_rows"))
            .select(COMP, F.col("day.start").alias("day_start"), "cost_usd", "n_rows"))


def behind_watermark(ledger: DataFrame, closed: DataFrame) -> DataFrame:
    """Rows that came after their day had been closed, per competition and UTC day: what the log holds beyond what
    the appended sums counted (days that are still open are left out)."""
    day = F.window("ts", "1 day").start
    all_rows = ledger.groupBy(COMP, day.alias("day_start")).agg(
        F.count(F.lit(1)).alias("n_all"), F.sum(F.coalesce(F.col("cost_usd"), F.lit(0.0))).alias("cost_all"))
    end = closed.agg(F.max("day_start").alias("_end"))
    c = closed.select(F.col(COMP).alias("_k"), F.col("day_start").alias("_d"), "n_rows", "cost_usd")
    j = all_rows.join(F.broadcast(end), F.col("day_start") <= F.col("_end")).join(  # one row
        c, F.col(COMP).eqNullSafe(F.col("_k")) & (F.col("day_start") == F.col("_d")), "left")
    late = F.col("n_all") - F.coalesce("n_rows", F.lit(0))
    return j.where(late > 0).select(COMP, "day_start", late.alias("n_late"), (F.col("cost_all") - F.coalesce("cost_usd", F.lit(0.0))).alias("late_usd"))
