"""Runs of words against a search over all periods and places."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from leakfree.llm import periodic_runs
from leakfree.llm.queries import QUERIES
from tests.llm.cases import empty, frame, rows


def brute(w, least=12):
    """Maximal stretches for every period, by comparing words q apart; only smallest periods."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            part = w[s:i + q]
            if len(part) >= max(least, 2 * q) and all(part[:-p] != part[p:] for p in range(1, q)):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def damage(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = damage(doc_id, (text or "").encode().split())
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    best = min(((-n, s, p) for s, n, p in runs), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def random_words(r):
    letters, n = r.choice([1, 2, 3, 5]), r.randint(0, 70)
    w = [r.randint(1, letters) for _ in range(n)]
    if n > 4 and r.random() < 0.5:
        a, p = r.randrange(n), r.randint(1, n)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] + [r.randint(1, letters) for _ in range(r.randint(0, 20))]
    return w


@pytest.mark.parametrize("least", [2, 12])
def test_trees_find_all_runs(least):
    r = random.Random(least)
    for _ in range(600):
        w = random_words(r)
        assert sorted(periodic_runs.runs_of(w, least), key=lambda x: (x[0], x[2])) == brute(w, least), w


def test_stretches_lose_and_cut_no_run():
    r = random.Random(7)
    for _ in range(300):
        w = [b"w%d" % x for part in range(3) for x in [*random_words(r), *(r.randrange(10 ** 6) for _ in range(30))]]
        assert periodic_runs.runs_in(w) == brute(w)


def test_common_extension_equals_comparing():
    r = random.Random(3)
    w = [r.randint(1, 2) for _ in range(300)]
    right = periodic_runs.CommonExtension(*periodic_runs.SuffixTree(w).walk())
    for _ in range(2000):
        i, j = sorted(r.sample(range(300), 2))
        n = 0
        while j + n < 300 and w[i + n] == w[j + n]:
            n += 1
        assert right(periodic_runs.np.array([i]), periodic_runs.np.array([j]))[0] == n


def test_query_equals_all_periods(spark, tmp_path):
    """The query over a table with nulls, empty texts, copies, clashing columns and long periodic texts."""
    r = random.Random(5)
    more = [(100 + i, " \n".join(f"w{x}" for x in random_words(r)), "en", "a", *(1,) * 2, *("x",) * 2, 1, *("y",) * 4) for i in range(200)]
    line = " ".join(f"v{i}" for i in range(400))
    more.append((990, " ".join([line] * 3), "en", "a", *(1,) * 2, *("x",) * 2, 1, *("y",) * 4))
    table = [x for x in rows() if len((x[1] or "").split()) < 5000] + more
    spark.createDataFrame(table, frame(spark).schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(x[0], x[1]) for x in table), key=key)


def test_carried_columns_and_long_texts(spark):
    told = periodic_runs.scan(frame(spark))
    assert told.columns == [*frame(spark).columns, "runs", "collapsed"]
    assert told.count() == len(rows())
    assert periodic_runs.scan(empty(spark)).count() == 0
    clash = frame(spark).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("z")).withColumn("_row", F.lit(2))
    assert periodic_runs.scan(clash).select("runs").dtypes[0][1].startswith("array")
    unit = " ".join(f"u{i}" for i in range(30_011))
    row = periodic_runs.scan(spark.createDataFrame([(1, " ".join([unit, unit, "u0 u1 z"]))], "doc_id long, text string")).first()
    assert [tuple(x) for x in row["runs"]] == [(0, 2 * 30_011 + 2, 30_011)]
    assert row["collapsed"] == unit + " z"
