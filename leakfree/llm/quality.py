"""Quality rules: a rule bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one
``fail_bits`` long (bit r set: rule r failed).  A policy is a versioned set of rules, that is a
mask; applying it is ``fail_bits & mask == 0``, and ablations (how many documents come back if
one rule is left out) are aggregates over the masked bits.  Changing a policy never re-reads texts.

Defined results: a null text has no words (as the empty text); texts without words fail
``few_words`` only; null ids and repeated rows pass through, a row each; columns of the caller
keep their values, but a caller's column named like one of the ledger's is replaced; an empty
table gives an empty ledger.  DataFrame functions only, no shuffle: a document's size bounds the work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakfree.llm.common import packed, unpacked, whole, word_array

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``fails`` reads the measurement columns and is true where the rule rejects."""

    bit: int
    name: str
    fails: str


#: Bits are never reused for another meaning: a ledger stays readable under later policies.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_lines > 0 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
)
BASE = ("few_words", "repeated_words")


def mask(names) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in set(names))


#: version -> mask
POLICIES = {1: mask(BASE), 2: mask(r.name for r in RULES)}
CURRENT = 2


def _repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: words covered by 3-word windows that occur twice or more.

    Windows are packed as (32 hash bits, position) longs and sorted; equal neighbours are
    candidates, which are then compared as strings, so a hash collision changes nothing.
    """
    w = F.col("_w")
    window = lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2])
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    key = lambda i: F.shiftleft(F.xxhash64(w[i], w[i + 1], w[i + 2]), 32).bitwiseOR(i.cast("long"))
    df = df.withColumn("_s", F.sort_array(F.transform(starts, key)))
    s = F.col("_s")
    high = lambda x: F.shiftright(x, 32)
    near = lambda x, i: (((i > 0) & (high(F.get(s, i - 1)) == high(x)))
                         | ((i < F.size(s) - 1) & (high(F.get(s, i + 1)) == high(x))))
    df = df.withColumn("_c", F.transform(F.filter(s, near), lambda x: x.bitwiseAND(0xFFFFFFFF).cast("int")))
    df = df.withColumn("_k", F.array_sort(F.transform("_c", lambda i: F.struct(window(i).alias("k"), i.alias("i")))))
    k = F.col("_k")
    same = lambda x, j: (((j > 0) & (F.get(k, j - 1)["k"] == x["k"]))
                         | ((j < F.size(k) - 1) & (F.get(k, j + 1)["k"] == x["k"])))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter(k, same), lambda x: x["i"])))
    p = F.col("_p")
    gain = lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))
    return df.withColumn("n_repeat_words", F.aggregate(F.transform(p, gain), F.lit(0).cast("long"),
                                                       lambda a, x: a + x))


def ledger(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The caller's columns, the measurements and ``fail_bits``."""
    own = [c for c in docs.columns if c not in (*MEASURES, "fail_bits")]
    t = F.col("_t")
    df = packed(docs).withColumn("_t", whole(F.col("_row").getField(text)))
    df = df.withColumn("_w", word_array(t)).withColumn(
        "_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = (df.withColumn("n_words", F.size("_w").cast("long"))
          .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
          .withColumn("n_symbols", (F.size(F.split(t, r"[#*$%&|<>]")) - 1).cast("long"))
          .withColumn("n_lines", F.size("_l").cast("long"))
          .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")))
    df = _repeats(df)
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    # a generator of one row: filters on the bits stay above it and don't repeat the measuring
    entry = F.explode(F.array(F.struct(*MEASURES, "fail_bits"))).alias("_m")
    return df.withColumn("fail_bits", bits).select("_row", entry).select(
        *[F.col("_row").getField(c).alias(c) for c in own], "_m.*")


def passes(policy_mask: int, bits: str | Column = "fail_bits") -> Column:
    b = F.col(bits) if isinstance(bits, str) else bits
    return b.bitwiseAND(F.lit(policy_mask).cast("long")) == 0


def apply_policy(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with the verdict of one policy version; a ledger's own columns ``policy`` and ``kept`` (of an earlier
    version, or a caller's) give way to it."""
    return book.withColumn("policy", F.lit(version)).withColumn("kept", passes(POLICIES[version]))


def ablation(book: DataFrame, version: int = CURRENT, rules=RULES) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone (they would come back
    without it), and the policy's whole reject count.  One aggregate over the bit patterns,
    of which there are at most 2 ** len(rules)."""
    m = POLICIES[version]
    seen = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
                               for r in rules if m >> r.bit & 1])).alias("r")
    each = seen.select("bits", "n", rows).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum("n").alias("n_documents"))


def keep(docs: DataFrame, version: int = CURRENT, text: str = "text") -> DataFrame:
    """Filtering form: the documents that the policy keeps, with their own columns only."""
    cols = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    book = ledger(row, "_text").where(passes(POLICIES[version]))
    return unpacked(book, cols)
