"""LED-1..5: cost ledger totals and budget logic per competition.

Running spend uses the split-aware ordered scan, so one competition with a huge ledger
is still summed in parallel.  The two order-dependent budget rules are rewritten so
they need no per-competition sequential loop over rows:

* LED-4 (budget doubling): spend is non-decreasing, so the check that doubles the
  budget for the j-th time happens at ``T_j = max(F_j, T_{j-1} + 1)`` where ``F_j`` is
  the first check whose prior spend exceeds ``B·2^j`` — one conditional ``min`` per
  level (as many levels as the largest spend needs), then a fold over that short array.
* LED-5 (wall-clock extensions): each approval restarts the clock at that call.  What a
  stretch of calls does to the clock that enters it is a step function, and functions of
  consecutive stretches compose (``segments.fold``): one range shuffle of the calls.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakfree.operators.ordered import Agg, ordinal, running
from leakfree.operators.segments import fold

COMP = "competition"


def totals(ledger: DataFrame) -> DataFrame:
    """LED-1: spend per competition and overall (competition null) — one rollup.
    Null or non-numeric costs are skipped; no rows → 0.0."""
    cost = F.col("cost_usd").cast("string").try_cast("double")
    return ledger.rollup(COMP).agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_usd"))


def total_for(ledger: DataFrame, competition=None) -> DataFrame:
    df = ledger if competition is None else ledger.where(F.col(COMP) == competition)
    return df.agg(F.coalesce(F.sum(F.col("cost_usd").cast("string").try_cast("double")), F.lit(0.0)).alias("total_usd"))


def cumulative(ledger: DataFrame, inclusive: bool = True, name: str = "spent", total_rows: int | None = None) -> DataFrame:
    cost = F.coalesce(F.col("cost_usd"), F.lit(0.0))
    return running(ledger.withColumn("_lf_c", cost), [COMP], ["seq"], [Agg(name, "sum", "_lf_c")],
                   inclusive, total_rows=total_rows).drop("_lf_c")


def budget_breach(ledger: DataFrame, budget: float) -> DataFrame:
    """LED-3: the first call after which cumulative spend exceeds the budget."""
    c = cumulative(ledger)
    return (c.where(F.col("spent") > budget).groupBy(COMP)
            .agg(F.min_by(F.struct("seq", "spent"), F.col("seq")).alias("b"))
            .select(COMP, F.col("b.seq").alias("breach_seq"), F.col("b.spent").alias("spent_at_breach")))


def budget_state(ledger: DataFrame, budget: float, carry: DataFrame | None = None, levels: int | None = None,
                 total_rows: int | None = None) -> DataFrame:
    """LED-4 as a fold with a carry: ``(competition, spent, doublings, breach_seq, last_seq)`` after the given rows.

    Each iteration first checks ``spent_before > budget`` and doubles the budget once.  ``carry``
    holds the same columns for competitions that go on from an earlier state.  The number of
    levels follows from the data: no competition can double more often than
    ``log2(largest total spend / budget) + 1`` times."""
    cost = F.coalesce(F.col("cost_usd"), F.lit(0.0))
    if levels is None:
        top = ledger.groupBy(COMP).agg(F.sum(cost).alias("t")).agg(F.max("t")).first()[0] or 0.0
        if carry is not None:
            top += carry.agg(F.max("spent")).first()[0] or 0.0
        levels = max(1, math.ceil(math.log2(top / budget)) + 2) if top > budget else 1
    c = ordinal(cumulative(ledger, inclusive=False, name="before", total_rows=total_rows), [COMP], ["seq"], "t", total_rows=total_rows)
    c = c.withColumn("before", F.coalesce(F.col("before"), F.lit(0.0))).withColumn("cost", cost)
    if carry is not None:
        base = carry.select(F.col(COMP).alias("_k"), F.col("spent").alias("_spent"), F.col("doublings").alias("_n"),
                            F.col("breach_seq").alias("_breach"))
        c = c.join(base, F.col(COMP).eqNullSafe(F.col("_k")), "left").drop("_k")
        c = c.withColumn("before", F.col("before") + F.coalesce(F.col("_spent"), F.lit(0.0)))
    else:
        c = c.withColumns({"_n": F.lit(0).cast("long"), "_breach": F.lit(None).cast("long")})
    firsts = c.groupBy(COMP).agg(
        F.count(F.lit(1)).alias("m"), F.max_by(F.col("before") + F.col("cost"), F.col("t")).alias("spent"),
        F.max("_n").alias("_n"), F.max("_breach").alias("_breach"), F.max("seq").alias("last_seq"),
        F.min(F.when(F.col("before") + F.col("cost") > budget, F.col("seq"))).alias("first_breach"),
        F.array(*[F.struct(F.lit(j).alias("j"), F.min(F.when(F.col("before") > F.lit(budget * 2 ** j), F.col("t"))).alias("t"))
                  for j in range(levels)]).alias("f"))
    init = F.struct(F.coalesce("_n", F.lit(0)).cast("long").alias("n"), F.lit(0).cast("long").alias("last"),
                    F.lit(True).alias("alive"))

    def step(acc, level):
        tj = F.greatest(level["t"], acc["last"] + 1).cast("long")
        ok = acc["alive"] & level["t"].isNotNull() & (tj <= F.col("m"))
        return (F.when(level["j"] < F.coalesce("_n", F.lit(0)), acc)  # doubled before these rows
                .when(ok, F.struct((acc["n"] + 1).alias("n"), tj.alias("last"), F.lit(True).alias("alive")))
                .otherwise(F.struct(acc["n"].alias("n"), acc["last"].alias("last"), F.lit(False).alias("alive"))))

    return firsts.select(COMP, "spent", F.aggregate("f", init, step)["n"].alias("doublings"),
                         F.coalesce("_breach", "first_breach").alias("breach_seq"), "last_seq")


def budget_doublings(ledger: DataFrame, budget: float, levels: int | None = None) -> DataFrame:
    """LED-4: approvals (budget doublings) and the budget after them."""
    return budget_state(ledger, budget, levels=levels).select(
        COMP, "doublings", (F.lit(budget) * F.pow(F.lit(2.0), F.col("doublings"))).alias("final_budget"))


#: A stretch of calls as a function of the clock that enters it.  ``ts`` are the calls that may be its first
#: restart, ``out`` the clock that leaves the stretch then and ``n`` the restarts; a clock that no call of ``ts``
#: exceeds by the limit passes unchanged.
CLOCK = "head double, ts array<double>, out array<double>, n array<bigint>"


def _restarts(ts: np.ndarray, limit: float) -> dict:
    """The function of calls at ``ts`` (in order).  A clock that enters is no later than the first call, so the
    first restart is at the latest at the first call after ``ts[0] + limit``."""
    size = len(ts)
    following = np.searchsorted(ts, ts + limit, side="right")
    out, n = ts.copy(), np.ones(size, np.int64)
    for i in range(size - 1, -1, -1):
        j = following[i]
        if j < size:
            out[i], n[i] = out[j], n[j] + 1
    some = slice(0, min(size, int(following[0]) + 1))
    return {"head": float(ts[0]), "ts": ts[some], "out": out[some], "n": n[some]}


def _then(states: list[dict], limit: float) -> dict:
    """The function of stretches one after the other."""
    head = states[0]["head"]
    ts, out, n = (np.asarray(states[0][c]) for c in ("ts", "out", "n"))
    for s in states[1:]:
        s_ts, s_out, s_n = (np.asarray(s[c]) for c in ("ts", "out", "n"))
        at = np.searchsorted(s_ts, out + limit, side="right")
        hit = at < len(s_ts)
        out, n = out.copy(), n.copy()
        out[hit], n[hit] = s_out[at[hit]], n[hit] + s_n[at[hit]]
        if not len(ts) or ts[-1] <= head + limit:  # a clock may pass all calls so far
            ts, out, n = (np.concatenate(p) for p in ((ts, s_ts), (out, s_out), (n, s_n)))
            some = int(np.searchsorted(ts, head + limit, side="right")) + 1
            ts, out, n = ts[:some], out[:some], n[:some]
    return {"head": head, "ts": ts.tolist(), "out": out.tolist(), "n": n.tolist()}


def wall_clock_extensions(ledger: DataFrame, limit_s: float, ts: str = "ts_s", chunk: int = 100_000) -> DataFrame:
    """LED-5: how many times the wall-clock budget had to be extended.

    The clock starts at the first call; before each call, if more than ``limit_s``
    seconds passed since the clock (re)started, an approval restarts it at that call.  Calls
    without a time aren't checked.  What a stretch of calls does to a clock is a function (a step per call
    within the limit of its first), and functions compose: one range shuffle, hot keys split."""
    calls = ledger.select(COMP, F.col(ts).cast("double").alias("_ts")).where(F.col("_ts").isNotNull() & ~F.isnan("_ts"))

    def reduce_rows(rows: pa.Table) -> dict:
        return _restarts(rows["_ts"].to_numpy(), limit_s)

    clocks = fold(calls, COMP, ["_ts"], reduce_rows, lambda states: _then(states, limit_s), CLOCK, chunk)
    first = F.filter("ts", lambda t: t > F.col("head") + limit_s)
    at = F.size("ts") - F.size(first) + 1
    timed = clocks.select(COMP, F.when(F.size(first) > 0, F.element_at("n", at)).otherwise(F.lit(0)).cast("long").alias("extensions"))
    every = ledger.select(COMP).distinct().withColumnRenamed(COMP, "_k")
    return every.join(timed, F.col("_k").eqNullSafe(F.col(COMP)), "left").select(
        F.col("_k").alias(COMP), F.coalesce("extensions", F.lit(0).cast("long")).alias("extensions"))
