"""One thin query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakfree.llm import (conversation_repair, decontamination, exact_dedup, katz, license_scan, mixing, near_dedup, packing,
                          periodic_runs, quality, secret_scan, token_files, toxicity)
from leakfree.llm import sql
from leakfree.llm.common import documents, shared_path, whole, word_array, written
from leakfree.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op10_quality_rules", sql.QUALITY)
def op10(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    book = quality.apply_policy(quality.ledger(docs))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality.passes(quality.POLICIES[1])).alias("base_failed"), "kept", "fail_bits", "policy")


@query("op9_source_mix", sql.MIX)
def op9(spark, sf_dir):
    sizes = written(documents(spark, sf_dir).select(
        "doc_id", "source", F.size(word_array(whole("text"))).cast("long").alias("size")), "mix-sizes")
    out = mixing.decide(sizes, written(mixing.plan(sizes), "mix-plan"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op6_exact_dedup", sql.EXACT)
def op6(spark, sf_dir):
    d = exact_dedup.dedup(documents(spark, sf_dir))
    return d.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir))


@query("op8_token_files")
def op8(spark, sf_dir):
    path = shared_path(spark, "token-files")
    token_files.write(documents(spark, sf_dir), path)
    return token_files.read(spark, path)


@query("op7_near_dedup")
def op7(spark, sf_dir):
    return near_dedup.near_dedup(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


@query("op3_secret_scan")
def op3(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return secret_scan.report(docs, secret_scan.train(secret_scan.labelled_samples(docs)))


@query("op4_toxicity")
def op4(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "toxic")
    model, seen = toxicity.fit(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return toxicity.scores(seen, model)


@query("op5_katz_scores")
def op5(spark, sf_dir):
    return katz.score(documents(spark, sf_dir).select("doc_id", "text"))


@query("op1_license_scan")
def op1(spark, sf_dir):
    """Documents as files source/lang/doc_id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    files = documents(spark, sf_dir).select("doc_id", path.alias("path"), "text")
    return license_scan.licenses(files).select(
        "doc_id", "path", "license", F.round("score", 9).alias("score"), "first_line", "lines", "effective", "origin")


@query("op11_decontamination", sql.DECONTAMINATE)
def op11(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select("item_id", "text")
    told = decontamination.report(documents(spark, sf_dir).select("doc_id", "text"), items, ["doc_id"])
    d = told.select("doc_id", "decontamination.*")
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op12_periodic_runs", sql.RUNS)
def op12(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", periodic_runs.damaged("doc_id", whole("text")).alias("text"))
    told = periodic_runs.scan(docs, ["doc_id"])
    best = periodic_runs.longest("runs")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"),
        ((1000 * best["length"] - (1000 * best["length"]) % best["period"]) / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_conversation_repair", sql.REPAIR)
def op13(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversation_repair.report(conversation_repair.damaged(rows), rows.select("conv_id").distinct())
