"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words.  A document's wanted copies are
``min(cap, c * g(size))`` with a size class weight ``g`` and ``c`` fitted so that the wanted words
sum to the target.  The whole part is allocated for certain; the fraction is the inclusion
probability p of one more copy.  Documents are ranked by random odds over inclusion odds,
``u/(1-u) / (p/(1-p))`` with u from a hash of (seed, id), and taken in that order until the
source's words are reached: a fixed-size unequal-probability sample, the same in every run.

The cut in the ranking is found without ordering a source in one task: ranks are counted in
``BINS`` equal steps of a monotone transform, the cut step is found on those counts, its rows are
counted in ``BINS`` finer steps, and only the finest step holding the cut is ordered row by row.

Defined results: a null or wordless text has size 0, takes 0 words and is never copied; a null
source is a source of its own, last; repeated rows are ranked next to each other and each counts; an empty
table gives no rows.  Callers' columns are kept by ``mix``; names of ours never clash (see ``packed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakfree.llm.common import packed, unpacked, whole, word_array, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
BINS = 4096


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in (0, 1) from 52 bits of md5(seed:id); the same number in any engine."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 52)


def size_class(size: Column) -> Column:
    """Weight of a document by size: bits of its number of words (0 for none)."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.size(word_array(whole(text))).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per source: source_size, target and the factor c of the wanted copies.

    Works on one row per source (and per source and size class, at most 64 of those).  Targets are
    ``min(cap * source_size, level * weight)``; the level at which they sum to the share is found by
    the order of ``source_size / weight``, which is what repeated resharing converges to.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    pos = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(pos) - 1) % len(weights)) + 1)
    per = per.withColumn("w", w).withColumn("limit", F.col("source_size") * float(cap))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = (per.withColumn("total", F.sum("source_size").over(everything) * share)
           .withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                       / F.sum("w").over(onward)))
    # the level holds from the first source that its share doesn't fill; the sources before are full
    per = per.withColumn("free", F.col("level") * F.col("w") < F.col("limit"))
    per = per.withColumn("at", F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("w"), "level"))).over(everything))
    per = per.withColumn("target", F.when(F.col("at").isNull(), F.col("limit")).otherwise(
        F.least("limit", F.col("at")["level"] * F.col("w"))))
    per = written(per.select("source", "source_size", "target"), "mix-targets")
    # c: wanted words sum(min(cap, c * g) * size) are piecewise linear in c; classes by falling g fill first
    cls = sizes.where("size > 0").groupBy("source", size_class(F.col("size")).alias("g")).agg(F.sum("size").alias("s"))
    cls = _joined(cls, per)
    fall = Window.partitionBy("source").orderBy(F.col("g").desc())
    full = F.coalesce(F.sum("s").over(fall.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * float(cap)
    rest = F.sum(F.col("s") * F.col("g")).over(fall.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    cls = cls.withColumn("c", (F.col("target") - full) / rest)
    fits = F.col("c") * F.col("g") <= float(cap)
    c = cls.groupBy("source").agg(F.coalesce(F.max(F.when(fits, F.struct("g", "c")))["c"], F.lit(float(1 << 30))).alias("c"))
    return written(_joined(per, c, "left"), "mix-targets")


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source with null equal to null, keeping one source column."""
    r = right.withColumnRenamed("source", "_source")
    return left.join(r, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _copies(df: DataFrame, cap: int = CAP, seed: str = SEED, doc_id: str = "doc_id") -> DataFrame:
    """Adds ``sure`` (whole copies) and ``t``, the rank of the extra copy in (0, 1) (null: none wanted)."""
    want = F.least(F.lit(float(cap)), F.col("c") * size_class(F.col("size")))
    df = df.withColumn("want", F.coalesce(want, F.lit(0.0))).withColumn("sure", F.floor(F.col("want") + 1e-9))
    p = F.col("want") - F.col("sure")
    u = draw(F.col(doc_id), seed)
    # odds q = u/(1-u) / (p/(1-p)); t = q / (1+q) keeps their order
    up, down = u * (1 - p), (1 - u) * p
    return df.withColumn("t", F.when((p > 1e-9) & (F.col("size") > 0), up / (up + down)))


def _cut(ranked: DataFrame, budget: DataFrame, nearest: bool) -> DataFrame:
    """Per source the last rank (t, id) taken when its budget is filled in rank order.

    ``ranked``: source, t, doc_id, size; ``budget``: source, room (words).  nearest: the unit at
    the cut is also taken if more than half of it fits.  Rows of one id are one unit.
    """
    step1 = F.floor(F.col("t") * BINS).cast("int")
    step2 = F.floor((F.col("t") * BINS - F.floor(F.col("t") * BINS)) * BINS).cast("int")
    ranked = ranked.withColumn("b1", step1).withColumn("b2", step2)

    def where_cut(counts: DataFrame, by: str, room: DataFrame) -> DataFrame:
        run = Window.partitionBy("source").orderBy(by)
        c = _joined(counts, room).withColumn("upto", F.sum("s").over(run))
        over = F.struct(F.col(by), (F.col("room") - F.col("upto") + F.col("s")).alias("left"))
        return c.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("room"), over)).alias("x"),
                                       F.max(by).alias("last"), F.first("room").alias("room"))

    first = where_cut(ranked.groupBy("source", "b1").agg(F.sum("size").alias("s")), "b1", budget)
    first = written(first.select("source", F.col("x.b1").alias("c1"), F.col("x.left").alias("room")), "mix-cut")
    in1 = _joined(ranked, first.select("source", "c1")).where("b1 = c1").drop("c1")
    second = where_cut(in1.groupBy("source", "b2").agg(F.sum("size").alias("s")), "b2", first.select("source", "room"))
    second = written(second.select("source", F.col("x.b2").alias("c2"), F.col("x.left").alias("room")), "mix-cut")
    in2 = _joined(in1, second).where("b2 = c2")
    unit = in2.groupBy("source", "t", "doc_id").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
    run = Window.partitionBy("source").orderBy("t", F.col("doc_id").asc_nulls_first())
    unit = unit.withColumn("upto", F.sum("size").over(run))
    fits = (F.col("upto") - F.col("size") / 2 <= F.col("room")) if nearest else (F.col("upto") <= F.col("room"))
    rows = unit.groupBy("source").agg(F.max(F.when(fits, F.struct("t", F.col("doc_id").alias("id")))).alias("row"))
    out = _joined(_joined(first.select("source", "c1"), second.select("source", "c2"), "left"), rows, "left")
    step = (F.col("c1") + F.coalesce(F.col("c2"), F.lit(0)) / BINS) / BINS
    # no row of the cut step fits: everything before the step is taken; no cut step: everything is
    nothing = F.struct(step.alias("t"), F.lit(None).cast(unit.schema["doc_id"].dataType).alias("id"))
    return written(out.select("source", F.when(F.col("c1").isNull(), F.lit(None)).otherwise(
        F.coalesce("row", nothing)).alias("cut"), F.col("c1").isNull().alias("all")), "mix-cut")


def _within(cut: str, everything: str) -> Column:
    """Whether a row's rank is at or before the cut."""
    t, i = F.col("t"), F.col("doc_id")
    at, last = F.col(cut)["t"], F.col(cut)["id"]
    tie = (t == at) & (i.isNull() | F.coalesce(i <= last, F.lit(False)))
    return F.coalesce(t.isNotNull() & (F.coalesce(F.col(everything), F.lit(False)) | (t < at) | tie), F.lit(False))


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per source: source_size, target, c, and the two cuts.  The second cut fills the room
    that the first leaves, from documents that still fit.  ``sizes``: doc_id, source, size."""
    per = targets(sizes, weights, share, cap)
    ranked = written(_copies(_joined(sizes, per.select("source", "c")), cap, seed).select(
        "source", "doc_id", "size", "sure", "t"), "mix-ranked")
    sure = ranked.groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("sure_words"))
    budget = written(_joined(per, sure).select("source", (F.col("target") - F.col("sure_words")).alias("room")), "mix-room")
    extra = ranked.where("t IS NOT NULL").select("source", "t", "doc_id", "size")
    one = _cut(extra, budget, nearest=False).withColumnsRenamed({"cut": "cut1", "all": "all1"})
    flagged = _joined(extra, one).withColumn("in1", _within("cut1", "all1"))
    used = flagged.groupBy("source").agg(F.sum(F.when(F.col("in1"), F.col("size")).otherwise(0)).alias("used"))
    left = _joined(budget, used).select("source", (F.col("room") - F.col("used")).alias("room"))
    left = written(left, "mix-room")
    small = _joined(flagged.where("NOT in1"), left).where("size <= room").select("source", "t", "doc_id", "size")
    two = _cut(small, left, nearest=True).withColumnsRenamed({"cut": "cut2", "all": "all2"})
    return _joined(_joined(_joined(per, one, "left"), left, "left"), two, "left")


def decide(sizes: DataFrame, per: DataFrame, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and ``copies`` to rows with doc_id, source and size."""
    df = _copies(_joined(sizes, per), cap, seed)
    second = _within("cut2", "all2") & (F.col("size") <= F.col("room"))
    more = F.when(_within("cut1", "all1") | F.coalesce(second, F.lit(False)), 1).otherwise(0)
    return df.withColumn("copies", (F.col("sure") + more).cast("int")).drop(
        "c", "cut1", "all1", "cut2", "all2", "room", "want", "sure", "t")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED,
        text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mixed corpus: the caller's columns, each document repeated as often as it is taken.

    The texts aren't moved: the decision needs a document's own size and its source's one row.
    """
    rows = packed(docs).withColumns({
        "doc_id": F.col("_row").getField(doc_id), "source": F.col("_row").getField(source).cast("string"),
        "size": F.size(word_array(whole(F.col("_row").getField(text)))).cast("long")})
    per = written(plan(written(rows.select("doc_id", "source", "size"), "mix-sizes"), weights, share, cap, seed), "mix-plan")
    out = decide(rows, per, cap, seed).where("copies > 0")
    return unpacked(out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)
