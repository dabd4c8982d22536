"""Exact and near dedup, quality rules and source mix against brute force and SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from leakfree.llm import exact_dedup, mixing, near_dedup, quality
from leakfree.llm.common import documents, part_of
from leakfree.llm.queries import ORACLES, QUERIES
from leakfree.plans.parity import compare, duck
from pyspark.sql import functions as F
from tests.llm import cases

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), duck(SF).execute(ORACLES[name]).df()) is None


# quality rules

def measured(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def test_ledger_equals_brute_force(spark):
    book = quality.apply_policy(quality.ledger(cases.frame(spark))).collect()
    got = Counter((r.doc_id, r.text, *(r[c] for c in quality.MEASURES)) for r in book)
    assert got == Counter((r[0], r[1], *measured(r[1])) for r in cases.rows())
    assert {r.doc_id: r.kept for r in book if r.doc_id is not None}[0]
    assert set(cases.frame(spark).columns) <= set(quality.ledger(cases.frame(spark)).columns)


def test_keep_returns_the_callers_rows(spark):
    kept = quality.keep(cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns
    left = {r.doc_id for r in kept.collect()}
    assert {0, 1, 10, 15} <= left and not left & {5, 6, 7, 8, 9, 11, 13, 14}
    assert quality.keep(cases.empty(spark)).count() == 0


def test_ablation_equals_counting(spark):
    book = quality.ledger(documents(spark, SF))
    bits = [r.fail_bits for r in book.collect()]
    for r in quality.ablation(book).collect():
        assert r.n_failed == sum(bool(b & r.bit) for b in bits)
        assert r.n_only == sum(b == r.bit for b in bits)
        assert r.n_rejected == sum(b != 0 for b in bits) and r.n_documents == len(bits)


def test_older_policy_reads_the_same_ledger(spark):
    book = quality.ledger(cases.frame(spark))
    v1 = {r.doc_id for r in quality.apply_policy(book, 1).where("kept").collect()}
    v2 = {r.doc_id for r in quality.apply_policy(book, 2).where("kept").collect()}
    assert v2 < v1 and 18 in v1 - v2


# exact dedup

def check_exact(got, rows):
    texts = defaultdict(list)
    for r in rows:
        texts[r[1] or ""].append(r[0])
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in texts.items()}
    want = Counter((r[0], top[r[1] or ""], len(texts[r[1] or ""])) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(texts)
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_exact_dedup(spark):
    got = exact_dedup.dedup(cases.frame(spark)).collect()
    check_exact(got, cases.rows())
    want = Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in cases.rows())
    assert Counter(bytes(r.digest).hex() for r in got) == want


def test_texts_are_compared_in_full_on_a_digest_clash(spark):
    weak = lambda body: F.unhex(F.lpad(F.hex(F.length(body) % 3), 2, "0"))
    check_exact(exact_dedup.dedup(cases.frame(spark), digest=weak).collect(), cases.rows())


def test_state_outlives_a_stream(spark):
    store = exact_dedup.DedupStore(spark)
    for part in cases.frame(spark).randomSplit([0.5, 0.5], 3):
        store.ingest(exact_dedup.located(part))
    sizes = Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in cases.rows())
    assert {bytes(r.digest).hex(): r.n for r in store.state().collect()} == dict(sizes)


def test_exact_keep(spark):
    kept = exact_dedup.keep(cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns
    rows = kept.collect()
    assert sorted(r.text or "" for r in rows) == sorted({r[1] or "" for r in cases.rows()})
    assert 1 in {r.doc_id for r in rows} and 0 not in {r.doc_id for r in rows}
    assert exact_dedup.keep(cases.empty(spark)).count() == 0


# near dedup

def shingled(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    bags = [shingled(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sizes = [sum(b.values()) for b in bags]
    for i in range(len(rows)):
        for j in range(i):
            lo, hi = sorted((sizes[i], sizes[j]))
            if lo < 0.8 * hi:
                continue
            both = sum((bags[i] & bags[j]).values())
            if not hi or both >= 0.8 * (lo + hi - both):
                parent[root(i)] = root(j)
    out = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        out[root(i)].append(k)
    return sorted((sorted(v, key=lambda x: (x is not None, x)) for v in out.values()), key=str)


def as_classes(got):
    out = defaultdict(list)
    for r in got:
        out[r.class_id].append(r.doc_id)
    return sorted((sorted(v, key=lambda x: (x is not None, x)) for v in out.values()), key=str)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_near_dedup_equals_all_pairs(spark, sf):
    docs = documents(spark, sf)
    got = near_dedup.near_dedup(docs).collect()
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert as_classes(got) == want
    assert sum(r.kept for r in got) == len(want)


def test_near_dedup_of_awkward_rows(spark):
    got = near_dedup.near_dedup(cases.frame(spark)).collect()
    one = {r.doc_id: (r.class_id, r.class_size) for r in got if r.doc_id not in (None, 3)}
    assert {k for k, v in one.items() if v[0] == 0} == {0, 1, 2, 4} and one[0][1] == 5  # and a null id
    assert {k for k, v in one.items() if v[0] == 5} == {5, 6, 7}
    assert one[16] == (16, 3) and one[17] == (17, 1)
    kept = near_dedup.keep(cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns
    assert kept.count() == sum(r.kept for r in got) == len(brute_classes([(i, r[1]) for i, r in enumerate(cases.rows())]))
    assert near_dedup.keep(cases.empty(spark)).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.choice(300, 4, replace=False):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"v{j}" for j in rng.integers(0, 5000, 300))) for i in range(50)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert as_classes(got) == brute_classes(rows)


def test_signatures_estimate_the_weighted_jaccard():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
    a, b = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
    b[:30] = a[:30]
    sig = near_dedup.bag_minhash([h[a > 0], h[b > 0]], [a[a > 0], b[b > 0]], 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5
    again = near_dedup.bag_minhash([h[b > 0]], [b[b > 0]], 4096)  # no document's signature depends on another's
    assert (again[0] == sig[1]).all()


# source mix

def test_mix_meets_its_targets(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = QUERIES["op9_source_mix"](spark, "/root/testdata/sf0.01").collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
    assert abs(sum(target.values()) / (1.5 * sum(size.values())) - 1) < 1e-9
    for s in target:
        assert target[s] <= 2 * size[s] + 1e-6
        assert abs(taken[s] / target[s] - 1) < 0.02


def test_targets_by_repeated_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 5, None: 400, "e": 0}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            want[s] += left * weight[s] / total
        left = sum(max(0.0, want[s] - 2 * sizes[s]) for s in free)
        full = {s for s in free if want[s] >= 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    assert got == pytest.approx(want)


def test_mix_of_awkward_rows(spark):
    docs = cases.frame(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    a, b = (Counter(mixing.mix(docs).select("doc_id", "text").collect()) for _ in range(2))
    assert a == b and not {5, 6, 7} & {r.doc_id for r in a}
    have = Counter(docs.select("doc_id", "text").collect())
    assert all(n <= 2 * have[r] for r, n in a.items())
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_part_of_is_crc32_of_the_id(spark):
    import zlib

    got = spark.range(50).select("id", part_of("id", 7).alias("p")).collect()
    assert all(r.p == zlib.crc32(str(r.id).encode()) % 7 for r in got)
