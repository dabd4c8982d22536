"""JRN-1..10, FLT-1..3, VAL-1: analytics over tool-call journals, all competitions at once.

Ordinals count *all* records of a competition (checkpoints included, 1-based, in ``seq``
order) and are computed before any kind filter (TRAP-1).  Per-competition results come
from grouped aggregates (partial aggregation, so a hot competition is combined map-side)
or from the split-aware ordered scan; "last n records" uses ``row_number() <= n`` which
Spark plans as a WindowGroupLimit (top-n kept per map partition before the shuffle).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakfree.functions.maps import canonical_args
from leakfree.functions.parse import cv_mean, cv_metric, higher_is_better
from leakfree.operators.ordered import ordinal
from leakfree.session import materialize

TOOL_KINDS = ["tool_call", "tool_error"]
SUBMIT_TOOLS = ["submit_kaggle", "submit_local"]
NOTE_CATEGORIES = ["observation", "decision", "hypothesis", "todo"]
COMP = "competition"


def is_tool(kind: Column | None = None) -> Column:
    return (F.col("kind") if kind is None else kind).isin(*TOOL_KINDS)


def with_ordinals(journal: DataFrame, name: str = "ordinal") -> DataFrame:
    """1-based position among all records of the competition (before any filter)."""
    return ordinal(journal, [COMP], ["seq"], name)


def tool_records(journal: DataFrame) -> DataFrame:
    """FLT-3: tool calls and tool errors, keeping the all-record ordinal."""
    return with_ordinals(journal).where(is_tool())


def behaviour(journal: DataFrame) -> DataFrame:
    """JRN-1/2/3: turns, errors, failure rate, first submission turn — one grouped job."""
    j = with_ordinals(journal)
    tool = is_tool()
    g = j.groupBy(COMP).agg(
        F.count_if(tool).alias("turns_per_run"),
        F.count_if(F.col("kind") == "tool_error").alias("error_count"),
        F.min(F.when(tool & F.col("tool").isin(*SUBMIT_TOOLS), F.col("ordinal"))).alias("turns_to_first_submission"))
    return g.withColumn("tool_call_failure_rate",
                        F.col("error_count") / F.greatest(F.col("turns_per_run"), F.lit(1)))


def tool_counts(journal: DataFrame) -> DataFrame:
    """JRN-1: ``map<tool, count>`` per competition (two-level aggregate)."""
    per = (journal.where(is_tool()).groupBy(COMP, F.coalesce("tool", F.lit("")).alias("tool"))
           .agg(F.count(F.lit(1)).alias("n")))
    return per.groupBy(COMP).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n"))))
                                 .alias("tool_counts"))


def cv_records(journal: DataFrame, full: str | None = None) -> DataFrame:
    """Successful train_cv calls with a mean (of column ``full`` where it has one, else parsed), with ordinal, metric and direction."""
    j = with_ordinals(journal)
    j = j.where((F.col("kind") == "tool_call") & (F.col("tool") == "train_cv"))
    summary = F.coalesce(F.col("result_summary"), F.lit(""))
    mean = cv_mean(summary) if full is None else F.coalesce(F.col(full), cv_mean(summary))
    j = j.select(COMP, "seq", "ordinal", mean.alias("mean"),
                 cv_metric(summary).alias("metric"))
    return j.where(F.col("mean").isNotNull() & ~F.isnan("mean")).withColumn(
        "hib", higher_is_better(F.col("metric")))


def best_score(journal: DataFrame) -> DataFrame:
    """JRN-4: best CV mean and the ordinal that first reached it.

    Each record's own metric gives the direction.  A competition whose records share
    one direction needs only ``max``/``min`` and the first ordinal at that value
    (strict improvement) — plain aggregates.  Competitions that switched metric mid-run
    are order-dependent; they go through a scan of clamps (``mixed_running_best``)."""
    cv = cv_records(journal)
    dirs = cv.groupBy(COMP).agg(F.min(F.col("hib").cast("int")).alias("_lo"),
                                F.max(F.col("hib").cast("int")).alias("_hi"))
    cv = cv.join(dirs, COMP)
    homo = cv.where(F.col("_lo") == F.col("_hi"))
    # max (mean, -ordinal) / min (mean, ordinal): the extreme value and the first turn at it
    ext = homo.groupBy(COMP).agg(F.max("hib").alias("hib"),
                                 F.max(F.struct("mean", (-F.col("ordinal")).alias("o"))).alias("_hi"),
                                 F.min(F.struct("mean", F.col("ordinal").alias("o"))).alias("_lo"))
    homo_out = ext.select(
        COMP, F.when(F.col("hib"), F.col("_hi.mean")).otherwise(F.col("_lo.mean")).alias("best_cv_mean"),
        F.when(F.col("hib"), -F.col("_hi.o")).otherwise(F.col("_lo.o")).cast("long").alias("turns_to_best_score"))

    # the order-dependent path only for competitions that switched direction (checked on
    # the one-row-per-competition table)
    if dirs.where(F.col("_lo") != F.col("_hi")).isEmpty():
        return homo_out
    mixed = cv.where(F.col("_lo") != F.col("_hi")).drop("_lo", "_hi")
    return homo_out.unionByName(_mixed_best(mixed))


FOLD_CHUNK_ROWS = 100_000
_INF = float("inf")


def _clamped(low: np.ndarray, high: np.ndarray, best: float | None) -> tuple[np.ndarray, np.ndarray]:
    """``best`` (None: no score yet) after each clamp ``b -> min(max(b, low), high)``, and which ones changed it."""
    after, changed = np.empty(len(low)), np.zeros(len(low), bool)
    for i, (l, h) in enumerate(zip(low.tolist(), high.tolist())):
        new = min(max(l if best is None else best, l), h)
        changed[i] = best is None or new != best
        after[i] = best = new
    return after, changed


def _carried(chunks: DataFrame) -> DataFrame:
    """Each chunk's incoming best, from the clamps (``lo``, ``hi``) of the chunks before it: one pass over a competition's
    chunks in order (n / chunk_rows rows), which may arrive in several batches."""
    kind = chunks.schema[COMP].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best, started = None, None, False
        for batch in batches:
            keys, low, high = (batch.column(c).to_pylist() for c in (COMP, "lo", "hi"))
            came = []
            for k, l, h in zip(keys, low, high):
                if not started or k != last:
                    last, best, started = k, None, True
                came.append(best)
                best = min(max(l if best is None else best, l), h)
            yield pa.RecordBatch.from_arrays([batch.column(COMP), batch.column("_chunk"), pa.array(came, pa.float64())],
                                             names=[COMP, "_chunk", "best_in"])

    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(parts, COMP).sortWithinPartitions(COMP, "_chunk").mapInArrow(
        walk, f"{COMP} {kind}, _chunk long, best_in double")


def mixed_running_best(cv: DataFrame, chunk_rows: int = FOLD_CHUNK_ROWS) -> DataFrame:
    """The best after every CV record, whatever directions the records have:
    ``(competition, ordinal, best_after, improved)``.

    Each step "keep the better of best and x" is a clamp ``b -> min(max(b, low), high)``
    (higher is better: ``low = x``; lower: ``high = x``; the first record: both), and clamps compose into
    clamps.  A competition's records are cut into chunks of at most ``chunk_rows`` (split-aware running
    count); a chunk's clamp is a fold of its rows, the best that enters a chunk comes from the clamps before it, and
    every chunk is then walked once from there.  Linear work; no task holds more than one chunk."""
    indexed = ordinal(cv, [COMP], ["ordinal"], "_k")
    indexed = indexed.withColumn("_chunk", F.floor((F.col("_k") - 1) / chunk_rows).cast("long"))
    first = F.col("_k") == 1
    low = F.when(first | F.col("hib"), F.col("mean")).otherwise(F.lit(-_INF))
    high = F.when(first | ~F.col("hib"), F.col("mean")).otherwise(F.lit(_INF))
    clamps = indexed.select(COMP, "_chunk", F.struct("ordinal", low.alias("l"), high.alias("h")).alias("r"))
    chunks = clamps.groupBy(COMP, "_chunk").agg(F.array_sort(F.collect_list("r")).alias("rs"))

    def compose(acc, x):  # acc, then x
        return F.struct(F.least(F.greatest(acc["l"], x["l"]), x["h"]).alias("l"), F.least(F.greatest(acc["h"], x["l"]), x["h"]).alias("h"))

    whole = F.struct(F.lit(-_INF).alias("l"), F.lit(_INF).alias("h"))
    chunks = materialize(chunks.withColumn("c", F.aggregate("rs", whole, compose)), reliable=True)
    came = _carried(chunks.select(COMP, "_chunk", F.col("c.l").alias("lo"), F.col("c.h").alias("hi")))
    came = came.select(F.col(COMP).alias("_k"), F.col("_chunk").alias("_c"), "best_in")
    todo = chunks.join(came, F.col(COMP).eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c"))).select(COMP, "rs", "best_in")
    kind = cv.schema[COMP].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rs = batch.column("rs")[i].values
                after, changed = _clamped(rs.field("l").to_numpy(), rs.field("h").to_numpy(), batch.column("best_in")[i].as_py())
                comp = pa.array([batch.column(COMP)[i].as_py()] * len(rs), batch.column(COMP).type)
                yield pa.RecordBatch.from_arrays([comp, rs.field("ordinal").cast(pa.int64()), pa.array(after), pa.array(changed)],
                                                 names=[COMP, "ordinal", "best_after", "improved"])

    return todo.mapInArrow(walk, f"{COMP} {kind}, ordinal long, best_after double, improved boolean")


def _mixed_best(cv: DataFrame, chunk_rows: int = FOLD_CHUNK_ROWS) -> DataFrame:
    """Best and turn-of-best when the direction changes between records (order-dependent)."""
    return mixed_running_best(cv, chunk_rows).groupBy(COMP).agg(
        F.max_by("best_after", "ordinal").alias("best_cv_mean"), F.max(F.when(F.col("improved"), F.col("ordinal"))).alias("turns_to_best_score"))


def stuck_loop(journal: DataFrame, window: int = 10, threshold: int = 5) -> DataFrame:
    """JRN-5: most repeated (tool, canonical args) among the last ``window`` records.

    One row per competition with a tool record in its window: the top signature
    (ties → first seen in the window), its count, and ``stuck = count >= threshold``."""
    w = Window.partitionBy(COMP).orderBy(F.desc("seq"))
    last = journal.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= window)
    sig = last.where(is_tool()).select(
        COMP, "seq", F.coalesce("tool", F.lit("")).alias("tool"), canonical_args(F.col("args")).alias("args"))
    counts = sig.groupBy(COMP, "tool", "args").agg(F.count(F.lit(1)).alias("repeats"),
                                                  F.min("seq").alias("_first"))
    top = counts.groupBy(COMP).agg(F.max_by(F.struct("tool", "args", "repeats"),
                                            F.struct(F.col("repeats"), -F.col("_first"))).alias("t"))
    return top.select(COMP, "t.tool", "t.args", "t.repeats", F.lit(window).alias("window"),
                      (F.col("t.repeats") >= threshold).alias("stuck"))


def last_call(journal: DataFrame) -> DataFrame:
    """JRN-6: the last tool record of each competition."""
    t = journal.where(is_tool())
    return t.groupBy(COMP).agg(F.max_by(F.struct("seq", "kind", "tool", "args"), F.col("seq")).alias("l")).select(
        COMP, F.col("l.seq").alias("seq"), F.col("l.kind").alias("kind"), F.col("l.tool").alias("tool"),
        F.col("l.args").alias("args"))


def run_finished(journal: DataFrame) -> DataFrame:
    """JRN-8: the run is finished when its last tool record is ``done``."""
    return last_call(journal).select(COMP, (F.coalesce(F.col("tool"), F.lit("")) == "done").alias("finished"))


def resume_summary(journal: DataFrame, window: int = 10, threshold: int = 5) -> DataFrame:
    """JRN-7: total calls, errors, last call and stuck loop per competition."""
    b = behaviour(journal).select(COMP, F.col("turns_per_run").alias("total_calls"), "error_count")
    lc = last_call(journal).select(COMP, F.col("tool").alias("last_tool"), F.col("seq").alias("last_seq"))
    st = stuck_loop(journal, window, threshold).where("stuck").select(
        COMP, F.col("tool").alias("stuck_tool"), F.col("repeats").alias("stuck_repeats"))
    return b.join(lc, COMP, "left").join(st, COMP, "left")


def _json_str(c: Column) -> Column:
    """A JSON string literal of ``c`` (quotes and escapes), null → JSON ``""``."""
    return F.regexp_replace(F.to_json(F.array(F.coalesce(c, F.lit("")))), r"^\[|\]$", "")


def rebuild_conversation(journal: DataFrame) -> DataFrame:
    """JRN-9: two messages per tool record of every *unfinished* competition.

    (model, '', tool call {id, name, args}) then (tool, '{"tool": name, "result": text}');
    the id falls back to ``resume_<message index>`` when missing or empty; checkpoints are
    skipped.  Finished competitions cannot be resumed and yield no messages."""
    t = ordinal(journal.where(is_tool()), [COMP], ["seq"], "_i")
    t = t.join(run_finished(journal).where(~F.col("finished")).select(COMP), COMP, "left_semi")
    i0 = (F.col("_i") - 1) * 2
    name = F.coalesce(F.col("tool"), F.lit("unknown"))
    call_id = F.coalesce(F.nullif(F.col("tool_call_id"), F.lit("")),
                         F.concat(F.lit("resume_"), i0.cast("string")))
    result = F.when(F.col("kind") == "tool_call", F.coalesce("result_summary", F.lit(""))).otherwise(
        F.coalesce("error", F.lit("")))
    payload = F.concat(F.lit('{"tool": '), _json_str(name), F.lit(', "result": '), _json_str(result), F.lit("}"))
    msgs = F.array(
        F.struct(i0.alias("msg_no"), F.lit("model").alias("role"), F.lit("").alias("content"),
                 call_id.alias("tool_call_id"), name.alias("tool_name"),
                 F.coalesce(F.col("args"), F.lit("{}")).alias("tool_args")),
        F.struct((i0 + 1).alias("msg_no"), F.lit("tool").alias("role"), payload.alias("content"),
                 F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("tool_name"),
                 F.lit(None).cast("string").alias("tool_args")))
    return t.select(COMP, F.explode(msgs).alias("m")).select(COMP, "m.*")


def journal_sizes(journal: DataFrame, submissions: DataFrame) -> DataFrame:
    """JRN-10: journal records (checkpoints included) and submission rows per competition."""
    a = journal.groupBy(COMP).agg(F.count(F.lit(1)).alias("journal_records"))
    b = submissions.groupBy(COMP).agg(F.count(F.lit(1)).alias("submissions"))
    return a.join(b, COMP, "full").select(
        COMP, F.coalesce("journal_records", F.lit(0)).alias("journal_records"),
        F.coalesce("submissions", F.lit(0)).alias("submissions"))


def notes_by_category(notes: DataFrame, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """FLT-2: valid notes (optionally one category) and the quarantined invalid ones."""
    valid = F.col("category").isin(*NOTE_CATEGORIES)
    good = notes.where(valid)
    if category is not None:
        if category not in NOTE_CATEGORIES:
            raise ValueError(f"unknown note category {category!r}; allowed: {NOTE_CATEGORIES}")
        good = good.where(F.col("category") == category)
    return good, notes.where(~valid | F.col("category").isNull())


# ---------------------------------------------------------------- VAL-1
# Argument constraints of the 13 tools — (tool, key, type, required, enum, min, max).
TOOL_ARGS = [
    ("read_context", None, None, False, None, None, None),
    ("read_file", "path", "string", True, None, None, None),
    ("write_file", "path", "string", True, None, None, None),
    ("write_file", "content", "string", True, None, None, None),
    ("sample_rows", "table", "string", True, None, None, None),
    ("sample_rows", "n", "integer", False, None, 1, 100),
    ("sample_rows", "random", "boolean", False, None, None, None),
    ("take_note", "category", "string", True, "observation,decision,hypothesis,todo", None, None),
    ("take_note", "content", "string", True, None, None, None),
    ("set_cv", "kind", "string", True, "kfold,stratified_kfold,time_series,group_kfold", None, None),
    ("set_cv", "n_splits", "integer", False, None, 2, 20),
    ("set_cv", "group_col", "string", False, None, None, None),
    ("train_cv", None, None, False, None, None, None),
    ("submit_local", "label", "string", True, None, None, None),
    ("done", "summary", "string", True, None, None, None),
    ("run_python", "code", "string", True, None, None, None),
    ("run_python", "timeout_s", "integer", False, None, 1, 600),
    ("run_python", "memory_mb", "integer", False, None, 64, 16384),
    ("set_metric", "name", "string", True, None, None, None),
    ("submit_kaggle", "csv_path", "string", True, None, None, None),
    ("submit_kaggle", "message", "string", True, None, None, None),
    ("request_human_approval", "action", "string", True, None, None, None),
    ("request_human_approval", "evidence_json", "string", False, None, None, None),
]


def constraints(spark) -> DataFrame:
    return spark.createDataFrame(
        TOOL_ARGS, "tool string, key string, type string, required boolean, enum string, min long, max long")


def args_conformance(journal: DataFrame) -> DataFrame:
    """VAL-1: ``(competition, seq, tool, key, violation)`` for every tool record whose args
    break the tool's schema: unknown tool, args that aren't a JSON object (malformed), missing required
    key, unexpected key, wrong type, value outside the enum or the integer range.

    Values keep their JSON types (VARIANT): a string is a string (``"7"`` is no integer, 5 no string), an
    integer any whole number, also written 5.0, a boolean true or false; null has no type.  One pass: the
    constraints of a tool are one row of a constant table (a few dozen entries), which is broadcast."""
    rules = F.broadcast(constraints(journal.sparkSession).groupBy(F.col("tool").alias("_tool")).agg(F.map_from_entries(
        F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", F.struct(
            "type", "required", F.split("enum", ",").alias("enum"), "min", "max"))))).alias("rules")))
    parsed = F.try_parse_json(F.coalesce("args", F.lit("{}")))
    t = journal.where(is_tool()).select(COMP, "seq", F.coalesce("tool", F.lit("")).alias("tool"),
                                        F.try_variant_get(parsed, "$", "map<string,variant>").alias("given"))
    t = t.join(rules, F.col("tool") == F.col("_tool"), "left")
    found = lambda key, kind: F.struct(key.cast("string").alias("key"), F.lit(kind).alias("violation"))
    only = lambda kind: F.array(found(F.lit(None), kind))
    missing = F.transform(F.filter(F.map_entries("rules"), lambda r: r["value"]["required"] & ~F.map_contains_key("given", r["key"])),
                          lambda r: found(r["key"], "missing_required"))

    def judged(entry: Column) -> Column:
        rule = F.element_at("rules", entry["key"])
        kind, text = F.schema_of_variant(entry["value"]), F.try_variant_get(entry["value"], "$", "string")
        number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(entry["value"], "$", "double"))
        is_int = F.coalesce(number == F.rint(number), F.lit(False))
        integer = rule["type"] == "integer"
        violation = (F.when(rule.isNull(), F.lit("unexpected_key"))
                     .when((integer & ~is_int) | ((rule["type"] == "boolean") & (kind != "BOOLEAN"))
                           | ((rule["type"] == "string") & (kind != "STRING")), F.lit("wrong_type"))
                     .when(rule["enum"].isNotNull() & ~F.array_contains(rule["enum"], text), F.lit("not_in_enum"))
                     .when(integer & rule["min"].isNotNull() & (number < rule["min"]), F.lit("below_minimum"))
                     .when(integer & rule["max"].isNotNull() & (number > rule["max"]), F.lit("above_maximum")))
        return F.struct(entry["key"].alias("key"), violation.alias("violation"))

    wrong = F.filter(F.transform(F.map_entries("given"), judged), lambda x: x["violation"].isNotNull())
    every = (F.when(F.col("rules").isNull(), only("unknown_tool")).when(F.col("given").isNull(), only("malformed_args"))
             .otherwise(F.concat(missing, wrong)))
    return t.select(COMP, "seq", "tool", F.explode(every).alias("v")).select(COMP, "seq", "tool", "v.key", "v.violation")
