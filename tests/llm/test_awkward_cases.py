"""Cases that once gave wrong results: secrets beside identifiers, packers, later batches of the dedup state, exploded scans."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakfree.llm import exact_dedup, near_dedup, packing, secret_scan
from leakfree.llm.common import documents

MID = "/root/testdata/sf0.01"

#: Names of many kinds, none of them taken from the corpus.
ORDINARY = """getUserAccountSettingsByIdentifier CONFIGURATION_MAX_CONNECTIONS_DEFAULT https-example-com-some-long-url-slug-here
AbstractSingletonProxyFactoryBean test_that_the_result_is_not_empty src/main/java/org/example/UserController.java
some-very-long-feature-branch-name-2024-01-31 com.example.project.service.UserAccountService kubernetes.io/ingress.class/nginx
MAXIMUM_NUMBER_OF_RETRIES_EXCEEDED_ERROR this-is-a-blog-post-about-streaming-joins user_profile_picture_upload_handler_v2
spark.sql.adaptive.coalescePartitions.enabled usr/local/share/applications/defaults.list InvalidArgumentExceptionHandler
docs/getting-started/installation-guide.md calculateMonthlyInterestRate2 NOT_AUTHORIZED_FOR_THIS_RESOURCE
__initialize_global_state_machine__ customer-support-ticket-number-10293 ReactDOMServerRenderingTransaction
node_modules/lodash/fp/placeholder.js application/vnd.openxmlformats-officedocument background-image-position-x-offset
com.google.common.collect.ImmutableList DEFAULT_CONNECTION_TIMEOUT_SECONDS_30""".split()


@pytest.fixture(scope="module")
def table(spark):
    return secret_scan.train(secret_scan.labelled_samples(documents(spark, MID).select("doc_id", "text")))


def flagged(spark, table, strings):
    rows = [(i, f"value {s} end") for i, s in enumerate(strings)]
    got = secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()
    return [r.n_markov > 0 for r in sorted(got, key=lambda r: r.doc_id)]


def test_identifiers_are_not_secrets(spark, table):
    assert np.mean(flagged(spark, table, ORDINARY)) <= 0.04
    assert not any(flagged(spark, table, ORDINARY[:3]))


def test_random_strings_are_secrets(spark, table):
    r = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = ["".join(r.choice(letters + extra) for _ in range(n)) for n in (24, 32, 40, 64) for extra in ("", "+/", "_-") for _ in range(20)]
    secrets = [s if s[-1].isalnum() else s[:-1] + "a" for s in secrets]
    hits = flagged(spark, table, secrets)
    assert np.mean(hits) >= 0.95
    dotted = ".".join("".join(r.choice(letters) for _ in range(30)) for _ in range(3))
    one = secret_scan.strings(spark.createDataFrame([(1, f"jwt {dotted}. Next")], "doc_id long, text string"), table).first()
    assert (one.kind, one.string) == ("markov", dotted)


@pytest.mark.parametrize("partitions", ["8", "200"])
def test_packing_does_not_depend_on_the_partitions(spark, partitions):
    r = random.Random(2)
    texts = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(50, 1700)))) for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    bound = sum(x.length for x in got) / packing.SEQUENCE
    assert len({x.sequence_id for x in got}) <= 1.03 * bound + 1
    for i in {x.sequence_id for x in got}:
        places = sorted((x.offset, x.length) for x in got if x.sequence_id == i)
        assert [p[0] for p in places] == [0, *np.cumsum([p[1] for p in places])[:-1]] and sum(p[1] for p in places) <= packing.SEQUENCE


def weak(body):
    return F.unhex(F.lpad(F.hex(F.length(body) % 3), 2, "0"))


def test_texts_of_later_batches_are_compared(spark, tmp_path):
    """Hits on earlier batches: bytes decide, and a call returns its own rows."""
    path = str(tmp_path / "state")
    one = spark.createDataFrame([(1, "aaa"), (2, "ccc"), (3, "dddd")], "doc_id long, text string")
    two = spark.createDataFrame([(4, "bbb"), (5, "aaa"), (6, "dddd"), (7, "ee")], "doc_id long, text string")
    assert exact_dedup.dedup(one, path=path, digest=weak).count() == 3
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(two, path=path, digest=weak).collect()}
    assert got == {4: (4, 1, True), 5: (5, 2, True), 6: (6, 2, True), 7: (7, 1, True)}


def test_a_second_call_returns_its_own_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 40}") for i in range(100)], "doc_id long, text string")
    path = str(tmp_path / "state")
    assert exact_dedup.dedup(docs, path=path).count() == 100
    again = exact_dedup.dedup(docs, path=path).collect()
    assert len(again) == 100 and all(r.group_size in (4, 6) for r in again)


def test_rows_of_an_exploded_scan_are_told_apart(spark, tmp_path):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(10 ** 6)}" for _ in range(40)) for _ in range(30)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    twice = spark.read.parquet(f"{tmp_path}/t").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    assert Counter(x.text for x in exact_dedup.keep(twice).collect()) == Counter(texts)
    assert Counter(x.text for x in near_dedup.keep(twice).collect()) == Counter(texts)


def test_slices_hold_few_words():
    sizes = [0, 5, 300_000, 1, 40_000, 40_000, 40_000, 0]
    offsets = np.concatenate([[7], 7 + np.cumsum(sizes)])
    got = list(near_dedup._slices(offsets))
    assert [n for at, n in got] and sum(n for _, n in got) == len(sizes)
    assert all(n == 1 or sum(sizes[at:at + n]) <= near_dedup.SLICE_WORDS for at, n in got)
    assert math.isclose(sum(sum(sizes[at:at + n]) for at, n in got), sum(sizes))
