"""Bind the provided tables to the logical inputs of the operators.

The operators work on logical tables (training table, tool-call journal, cost ledger,
leaderboard, spans, notes...).  The test data ships TPC-H-like tables plus ``events``
and ``conversations``; these functions derive the logical tables from them with
plain projections (no row is dropped), so every query's work grows with the inputs.
Each binding has a DuckDB twin in ``leakfree.plans.oracle`` used as the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakfree.functions.cost import call_cost

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- training table
def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer as a supervised table (unique row_id = o_orderkey)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    df = o.join(c, o.o_custkey == c.c_custkey, "left")
    return df.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("grp"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("cat"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("cat_missing"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("x_acct"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("c_acctbal")).alias("x_acct_missing"),
        F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("x_days"),
        F.col("o_totalprice").alias("y_reg"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_bin"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
        .otherwise(2).alias("y_cls"),
    )


def documents_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels ⋈ documents as a binary classification table (row_id = doc_id)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lb = table(spark, sf_dir, "labels")
    return lb.join(d, "doc_id").select(F.col("doc_id").alias("row_id"), "lang", "source",
                                      F.col("n_chars").cast("double").alias("n_chars"),
                                      F.col("quality").cast("int").alias("quality"),
                                      F.col("toxic").cast("int").alias("toxic"))


# ---------------------------------------------------------------- journal
def _tool(event_type: Column, event_id: Column) -> Column:
    return (F.when(event_type == "click",
                   F.when(event_id % 50 == 0, F.lit("done")).otherwise(F.lit("read_file")))
            .when(event_type == "view", "sample_rows")
            .when(event_type == "signup", "train_cv")
            .when(event_type == "purchase", "submit_kaggle")
            .otherwise(F.element_at(F.array(F.lit("train_cv"), F.lit("submit_kaggle"),
                                            F.lit("run_python"), F.lit("read_file")),
                                    (event_id % 4 + 1).cast("int"))))


def metric_of(user_id: Column) -> Column:
    return F.when(user_id % 2 == 0, F.lit("accuracy")).otherwise(F.lit("rmse"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → tool-call journal; one checkpoint record precedes every submit."""
    e = table(spark, sf_dir, "events")
    eid, et = F.col("event_id"), F.col("event_type")
    tool = _tool(et, eid)
    metric = metric_of(F.col("user_id"))
    mean_txt = F.when(eid % 17 == 0, F.lit("nan")).otherwise(F.format_string("%.4f", F.col("value")))
    summary = F.when(
        tool == "train_cv",
        F.concat(F.lit("train_cv complete: "),
                 F.when(F.col("user_id") % 2 == 0, F.lit("stratified_kfold")).otherwise(F.lit("kfold")),
                 F.lit(" (5 folds), metric="), metric, F.lit(", mean="), mean_txt,
                 F.lit(", std=0.0100, fold_scores=["),
                 F.format_string("%.2f, %.2f, %.2f, %.2f, %.2f", F.col("value") - 0.02, F.col("value") - 0.01,
                                 F.col("value"), F.col("value") + 0.01, F.col("value") + 0.02),
                 F.lit("], duration_s="),
                 F.format_string("%.2f", F.col("value"))),
    ).otherwise(F.concat(tool, F.lit(" ok "), F.col("value").cast("string")))
    calls = e.select(
        F.col("user_id").alias("competition"),
        (eid * 2 + 1).alias("seq"),
        F.col("ts"),
        F.when(et == "error", F.lit("tool_error")).otherwise(F.lit("tool_call")).alias("kind"),
        tool.alias("tool"),
        F.col("props").alias("args"),
        F.when(et != "error", summary).alias("result_summary"),
        F.when(et == "error", F.concat(F.lit("ToolError: failed with "),
                                       F.col("value").cast("string"))).alias("error"),
        F.when(eid % 3 == 0, F.lit(None).cast("string")).when(eid % 5 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("call_"), eid.cast("string"))).alias("tool_call_id"),
        F.lit(None).cast("string").alias("trigger"),
        F.lit(None).cast("string").alias("action"),
        F.lit(None).cast("string").alias("evidence"),
        F.lit(None).cast("string").alias("decision"),
    )
    checkpoints = e.where(et == "purchase").select(
        F.col("user_id").alias("competition"),
        (eid * 2).alias("seq"),
        F.col("ts"),
        F.lit("checkpoint").alias("kind"),
        F.lit(None).cast("string").alias("tool"),
        F.lit(None).cast("string").alias("args"),
        F.lit(None).cast("string").alias("result_summary"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("tool_call_id"),
        F.lit("submit_kaggle_gate").alias("trigger"),
        F.concat(F.lit("submit 'sub_"), eid.cast("string"), F.lit(".csv'")).alias("action"),
        F.col("props").alias("evidence"),
        decision_of(eid).alias("decision"),
    )
    return calls.unionByName(checkpoints)


def decision_of(event_id: Column) -> Column:
    return (F.when(event_id % 7 == 0, "deny").when(event_id % 7 == 1, "skip_check")
            .when(event_id % 7 == 2, "abort").otherwise("approve"))


# ---------------------------------------------------------------- notes
def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("competition"), F.col("event_id").alias("seq"), "ts",
        F.when(F.col("event_type") == "click", "observation")
        .when(F.col("event_type") == "view", "decision")
        .when(F.col("event_type") == "signup", "hypothesis")
        .when(F.col("event_type") == "purchase", "todo")
        .otherwise("remark").alias("category"),
        F.col("props").alias("content"))


# ---------------------------------------------------------------- cost ledger
# Model names assigned to conversations by conv_id % 5 (the last is unpriced).
LEDGER_MODELS = ["gemini-2.5-flash", "gemini-2.5-pro", "gemini-3-pro", "gemini-3-pro-large",
                 "experimental-model"]
LEDGER_EPOCH = 1704067200  # 2024-01-01T00:00:00Z


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations → one priced LLM call per turn."""
    c = table(spark, sf_dir, "conversations")
    n = F.length("text").cast("bigint")
    model = F.element_at(F.array(*[F.lit(m) for m in LEDGER_MODELS]),
                         (F.col("conv_id") % 5 + 1).cast("int"))
    df = c.select(
        F.col("conv_id").alias("competition"),
        F.col("turn").alias("seq"),
        (F.lit(LEDGER_EPOCH) + F.col("conv_id") * 86400 + F.col("turn") * 300 + n % 250).alias("ts_s"),
        model.alias("model"),
        F.when(F.col("role").isin("user", "system"), n).otherwise(F.lit(0).cast("bigint")).alias("input_tokens"),
        F.when(F.col("role") == "assistant", n).otherwise(F.lit(0).cast("bigint")).alias("output_tokens"),
        F.when((F.col("role") == "user") & (F.col("turn") >= 2), F.floor(n / 2).cast("bigint"))
        .otherwise(F.lit(0).cast("bigint")).alias("cached_tokens"),
    )
    df = df.withColumn("ts", F.timestamp_seconds("ts_s"))
    return call_cost(df, spark)


# ---------------------------------------------------------------- leaderboard
def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events purchases → leaderboard records (cv_at_submit null for every 11th id)."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return e.select(
        F.col("user_id").alias("competition"),
        F.col("event_id").alias("seq"),
        "ts",
        F.concat(F.lit("sub_"), F.col("event_id").cast("string"), F.lit(".csv")).alias("csv"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("cv_at_submit"),
        F.concat(F.lit("submission "), F.col("event_id").cast("string")).alias("message"),
        metric_of(F.col("user_id")).alias("metric"),
    )


# ---------------------------------------------------------------- spans
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders (root + run marker) and lineitems (children) as trace spans."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    okey = F.col("o_orderkey").cast("string")
    no_attrs = F.create_map().cast("map<string,string>")
    roots = o.select(
        F.col("o_orderdate").alias("ts"), okey.alias("trace_id"),
        F.concat(F.lit("o"), okey).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.lit("solve.loop").alias("name"),
        F.round(F.col("o_totalprice") * 1000).cast("bigint").alias("duration_ns"),
        F.lit("OK").alias("status"), no_attrs.alias("attributes"),
        F.lit(None).cast("string").alias("error"))
    markers = o.select(
        F.col("o_orderdate").alias("ts"), okey.alias("trace_id"),
        F.concat(F.lit("m"), okey).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.concat(F.lit("run:"), F.col("o_orderpriority")).alias("name"),
        F.lit(0).cast("bigint").alias("duration_ns"),
        F.lit("MARKER").alias("status"), no_attrs.alias("attributes"),
        F.lit(None).cast("string").alias("error"))
    lkey = F.col("l_orderkey").cast("string")
    name = (F.when(F.col("l_returnflag") == "R", "llm.call")
            .when(F.col("l_returnflag") == "A", "tool:train_cv").otherwise("tool:read_file"))
    attrs = (F.when(name == "llm.call", F.create_map(
        F.lit("usage.input_tokens"), F.round(F.col("l_quantity") * 100).cast("bigint").cast("string"),
        F.lit("usage.output_tokens"), F.round(F.col("l_quantity") * 10).cast("bigint").cast("string")))
        .when(F.col("l_tax") == 0, F.create_map(F.lit("error"), F.lit("tool failed")))
        .otherwise(no_attrs))
    children = li.select(
        F.col("l_shipdate").alias("ts"), lkey.alias("trace_id"),
        F.concat_ws("-", F.lit("l"), lkey, F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("span_id"),
        F.concat(F.lit("o"), lkey).alias("parent_span_id"),
        name.alias("name"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("duration_ns"),
        F.when(F.col("l_discount") == 0, "ERROR").otherwise("OK").alias("status"),
        attrs.alias("attributes"),
        F.when(F.col("l_discount") == 0, F.lit("ValueError: zero discount")).alias("error"))
    return roots.unionByName(markers).unionByName(children)
