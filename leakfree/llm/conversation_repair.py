"""Conversation repair: weighted CYK interval parsing of the rows of a conversation.

The rows of a repaired conversation must read ``(s?(ua)+)?`` by the initials of their roles.  The
repair grammar is that language with errors: a row may be kept (K, cost 0), given another role (R, 2) or
deleted (D, 3; the only edit of a blank or repeated row), an empty row may be inserted anywhere
(I, 2), and an undeleted row that breaks off adds 1.  In Chomsky normal form its symbols are the pairs
(p, q) of places in the language, "these rows lead from p to q":

    (p, q) -> (p, r) (r, q)        for every r
    (p, q) -> row                  by an edit, with insertions before the row (insertion closure)

A chart has a cell for every span of rows, holding each symbol's least (cost, audit), the audit being the
edits' initials; cells are filled by span length from all splits.  Least audits of the parts give
the least audit of the whole, as no audit of a cell is a proper prefix of another of equal cost.

A conversation may hold a third of all rows, so a chart covers at most ROWS rows.  Cells of
whole charts are the leaves of the next charts, SPANS of them at a time, until one cell is left
(log4(n / ROWS) rounds, each a grouping of a table that shrinks as much).  Positions come from the running
count that splits hot keys; edits join rows by conversation and place.  Only the digest of a whole
conversation is sequential by nature: it streams over sorted rows in bounded memory.

Defined results: rows are ordered by turn (nulls first), then role, text and copy; null roles and texts are one
space; a role without a first character fits nowhere; a null conversation is a conversation; a conversation without rows
has zeros, an empty audit and the empty text's digest; an empty table gives no rows; other columns are ignored; texts of
any length are whole.  Of repeated rows all but the first are duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakfree.llm.common import ship, shuffle_partitions, written
from leakfree.operators.ordered import ordinal

ROWS, SPANS = 16, 4
#: Rows of one conversation that one task may order; longer ones are split by range.
ROWS_PER_TASK = 100_000

#: The language as places (0 start, 1 after s, 2 after u, 3 after a), where it may end, costs, the roles by place.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
REROLE, DELETE, INSERT, BROKEN = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}

Cells = dict[tuple[int, int], tuple[int, str]]

#: Cheapest insertions from place to place.
CLOSURE: Cells = {(p, p): (0, "") for p in range(4)}
for _ in range(4):
    for (_p, _q), (_c, _a) in list(CLOSURE.items()):
        for _x in ROLES:
            _to = STEP.get((_q, _x))
            if _to is not None and (_c + INSERT, _a + "I") < CLOSURE.get((_p, _to), (99, "")):
                CLOSURE[_p, _to] = (_c + INSERT, _a + "I")


def joined(left: Cells, right: Cells, into: Cells) -> None:
    """Every (p, r) of the left span with every (r, q) of the right one, the least kept."""
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            rest = right.get((r, q))
            if rest is None:
                continue
            both, old = cost + rest[0], into.get((p, q))
            if old is None or both < old[0] or both == old[0] and audit + rest[1] < old[1]:
                into[p, q] = (both, audit + rest[1])


def leaf(initial: str, fault: str | None) -> Cells:
    """A row's cell: an edit after the insertions before it."""
    edit: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in ("blank", "duplicate"):
        more = BROKEN if fault == "truncated" else 0
        for (p, x), q in STEP.items():
            if x in ROLES:
                edit[p, q] = (REROLE + more, "R")
            if x == initial:
                edit[p, q] = min((more, "K"), edit.get((p, q), (99, "")))
    out: Cells = {}
    joined(CLOSURE, edit, out)
    return out


def chart(leaves: list[Cells]) -> Cells:
    """The cell of the whole span, from the cells of all spans, by length and over all splits."""
    n = len(leaves)
    cells = {(i, i + 1): leaf_ for i, leaf_ in enumerate(leaves)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            into: Cells = {}
            for k in range(i + 1, i + length):
                joined(cells[i, k], cells[k, i + length], into)
            cells[i, i + length] = into
    return cells[0, n]


def cheapest(cell: Cells) -> tuple[int, str]:
    """Cost and audit of the whole, with the insertions after the last row."""
    into: Cells = {}
    joined(cell, CLOSURE, into)
    return min(into[0, q] for q in FINAL if (0, q) in into)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with planted damage, by crc32 of ``conv_id:turn`` modulo 20:
    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 sets its role to user.
    Nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    d = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return d.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _key(conv_id: str | Column) -> Column:
    """The conversation as a text that also tells null."""
    c = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return F.coalesce(F.concat(F.lit("c"), c.cast("string")), F.lit("-"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` in order: conv, conv_id, turn, role, text, initial, pos (from 0) and the first fault of each
    (blank, duplicate, truncated or null)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copy = F.col("copy") if "copy" in rows.columns else F.lit(0)
    d = rows.select(_key("conv_id").alias("conv"), "conv_id", "turn", text("role").alias("role"), text("text").alias("text"), copy.alias("copy"))
    d = d.withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    d = ordinal(d, ["conv"], ["turn", "role", "text", "copy"], "pos", ROWS_PER_TASK)
    d = written(d.withColumn("pos", (F.col("pos") - 1).cast("bigint")), "conversation-rows")
    solid = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    seen = d.groupBy("conv", "same").agg(F.min("pos").alias("first_pos"))
    return d.join(seen, ["conv", "same"]).select(
        "conv", "conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), "pos",
        F.when(solid == "", "blank").when(F.col("first_pos") < F.col("pos"), "duplicate")
        .when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated").alias("fault"))


_SPAN = ("conv string, at bigint, first string, last string, illegal bigint, "
         "cells array<struct<p:int,q:int,cost:bigint,audit:string>>, cost bigint, audit string")


def _charted(groups: DataFrame, of_rows: bool) -> DataFrame:
    """Groups (conv, at, parts in order) to the spans that they make up."""
    schema = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()),
                        ("cells", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
                        ("cost", pa.int64()), ("audit", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, at, parts in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "parts"))):
                if of_rows:
                    leaves = [leaf(x["initial"], x["fault"]) for x in parts]
                    ends, illegal = [(x["initial"], x["initial"]) for x in parts], 0
                else:
                    leaves = [{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in x["cells"]} for x in parts]
                    ends, illegal = [(x["first"], x["last"]) for x in parts], sum(x["illegal"] for x in parts)
                illegal += sum(a[1] + b[0] not in ("su", "ua", "au") for a, b in zip(ends, ends[1:]))
                cell = chart(leaves)
                cost, audit = cheapest(cell)
                out.append({"conv": conv, "at": at, "first": ends[0][0], "last": ends[-1][1], "illegal": illegal, "cost": cost, "audit": audit,
                            "cells": [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ship(groups.sparkSession)
    return groups.mapInArrow(parse, _SPAN)


def parsed(rows: DataFrame) -> DataFrame:
    """(conv, illegal, cost, audit) of every conversation with rows, from ``faults``."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "initial", "fault"))).alias("parts")
    groups = rows.groupBy("conv", F.floor(F.col("pos") / ROWS).alias("at")).agg(parts)
    most = rows.agg(F.max("pos")).first()[0]
    spans, done, left = written(_charted(groups, of_rows=True), "repair-spans"), [], 1 + (most or 0) // ROWS
    whole = ["conv", "illegal", "cost", "audit"]
    while left > 1:
        length = spans.groupBy("conv").agg(F.count(F.lit(1)).alias("spans"))
        spans = spans.join(length, "conv")
        done.append(spans.where("spans = 1").select(whole))
        several = spans.where("spans > 1").groupBy("conv", F.floor(F.col("at") / SPANS).alias("next")).agg(
            F.array_sort(F.collect_list(F.struct("at", "first", "last", "illegal", "cells"))).alias("parts"))
        spans = written(_charted(several.withColumnRenamed("next", "at"), of_rows=False), "repair-spans")
        left = -(-left // SPANS)
    out = spans.select(whole)
    for d in done:
        out = out.unionByName(d)
    return out


def _edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with their edits: ``edit`` is the inserts before a row, its own edit and, at the last row, the inserts after."""
    edits = found.select("conv", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD](?:I+$)?"), F.lit(0))).alias("pos", "edit"))
    return rows.join(edits.withColumn("pos", F.col("pos").cast("bigint")), ["conv", "pos"]).select("conv", "pos", "role", "text", "edit")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[str, str, str]]]]:
    """Sorted rows of edits, each as (conv, the rows that come out of it: role, text, edit)."""
    conv, place = None, 0
    for batch in batches:
        for c, role, text, edit in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text", "edit"))):
            if c != conv:
                conv, place = c, 0
            out = []
            for e in edit:
                if e == "D":
                    continue
                if e != "K":
                    role_, text_ = ROLES["a" if place == 2 else "u"], "" if e == "I" else text
                else:
                    role_, text_ = role, text
                place = STEP[place, role_[0]]
                out.append((role_, text_, e))
            yield c, out


def _in_order(edited: DataFrame) -> DataFrame:
    return edited.repartition(shuffle_partitions(edited.sparkSession), "conv").sortWithinPartitions("conv", "pos")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv, at (from 0), role, text, edit (K, R or I)."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, out = None, 0, []
        for conv, made in _applied(batches):
            at = at if conv == last else 0
            last = conv
            for role, text, edit in made:
                out.append({"conv": conv, "at": at, "role": role, "text": text, "edit": edit})
                at += 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out)

    ship(rows.sparkSession)
    return _in_order(_edited(rows, found)).mapInArrow(put, "conv string, at bigint, role string, text string, edit string")


def _digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): digest of ``role:text`` of the repaired rows, joined by newlines, as a stream."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha, first, out = None, None, True, []
        for conv, made in _applied(batches):
            if conv != last:
                if sha:
                    out.append({"conv": last, "repaired_sha256": sha.hexdigest()})
                last, sha, first = conv, hashlib.sha256(), True
            for role, text, _ in made:
                sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        if sha:
            out.append({"conv": last, "repaired_sha256": sha.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out)

    ship(rows.sparkSession)
    return _in_order(_edited(rows, found)).mapInArrow(digest, "conv string, repaired_sha256 string")


def report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: faults of its rows, the cheapest repair and the repaired text's digest."""
    d = written(faults(rows), "conversation-faults")
    count = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    turn = F.col("turn").cast("decimal(20,0)")
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct("turn"), F.lit(0)).cast("bigint")
    told = d.groupBy("conv").agg(gaps.alias("gaps"), *[count(k) for k in ("blank", "duplicate", "truncated")])
    found = written(parsed(d), "repairs")
    out = (conversations.select("conv_id").distinct().withColumn("conv", _key("conv_id"))
           .join(told, "conv", "left").join(found, "conv", "left").join(_digests(d, found), "conv", "left"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return out.select("conv_id", *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
