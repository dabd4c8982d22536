"""Decontamination against a search for every window at every place."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from leakfree.llm import decontamination
from leakfree.llm.queries import QUERIES
from tests.llm.cases import empty, frame, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    held = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            held.setdefault(tuple(w[i:i + n]), set()).add(item)
    sizes = sorted({len(k) for k in held})
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in held:
                    hit |= set(range(i, i + n))
                    found |= held[tuple(w[i:i + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def world(seed):
    """Documents that hold windows, parts of windows and shuffled windows of items."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["Éa", "x9", "日本"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 5, 9, 10, 11, 25, 40]) if i > 3 else 10)) for i in range(40)]
    items = [(i, t) for i, t in items if len(t.split()) > 1 or r.random() < 0.2]
    items += [(None, text(12)), (7, text(14)), (60, None), (61, ""), (62, "... !"), (63, items[0][1]), (-4, items[0][1].upper())]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(r.randint(0, 4)):
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(w) - 9))
            kind = r.random()
            w = w if kind < 0.3 else w[a:a + r.randint(8, 12)] if kind < 0.8 else r.sample(w, len(w))
            parts += [text(r.randint(0, 30)), r.choice([" ", ", ", "\n", "_-_"]).join(w)]
        docs.append((i, r.choice(["", " "]).join(parts) if r.random() < 0.1 else " ".join(parts)))
    return docs, items


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("broadcast", [0, 8 << 20])
def test_query_equals_every_place(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", broadcast)
    docs, items = world(4)
    odd = [(x[0], x[1]) for x in rows()] + [(None, items[0][1] + " " + items[1][1]), (3, items[0][1]), (3, items[0][1])]
    items.append((70, " ".join(words(odd[0][1])[20:50])))
    table = docs + odd
    spark.createDataFrame(table, "doc_id long, text string").withColumns({"h": F.lit(1), "row": F.lit("r"), "places": F.lit(0)}) \
        .repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumns({"body": F.lit("b"), "n": F.lit(0)}) \
        .repartition(2).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op11_decontamination"](spark, str(tmp_path))
    assert got.columns[:6] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute(table, items)
    assert as_rows(got) == sorted(want, key=str)
    assert sum(x[5] for x in want) > 30


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    """Every probe passes: the join alone decides."""
    docs, items = world(9)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    told = decontamination.report(d, i, ["doc_id"]).select("doc_id", "decontamination.*")
    monkeypatch.setattr(decontamination.Probe, "find", lambda self, h: decontamination.np.arange(len(h)))
    again = decontamination.report(d, i, ["doc_id"]).select("doc_id", "decontamination.*")
    assert as_rows(told) == as_rows(again)


def test_spans_and_clean_keep_columns(spark):
    docs = frame(spark).withColumn("_row", F.lit(1)).withColumn("decontamination", F.lit(2))
    items = spark.createDataFrame([(5, "one two three"), (6, "la")], "item_id int, text string")
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns
    hit = [x for x in rows() if {"la"} & set(words(x[1])) or words(x[1]) == ["one", "two", "three"]]
    assert kept.count() == len(rows()) - len(hit) and hit
    one = decontamination.report(docs.where("doc_id = 9"), items).first()
    assert [tuple(s) for s in one["decontamination"]["spans"]] == [(0, 3)] and one["text"] == "one two three"
    assert decontamination.report(empty(spark), items).count() == 0
    nothing = decontamination.report(frame(spark), items.limit(0), ["doc_id"])
    assert nothing.count() == len(rows()) and nothing.where("decontamination.n_hit > 0").count() == 0
