"""Katz scores over all training words."""

import numpy as np
import pytest

from leakfree.llm import katz
from leakfree.llm.common import documents
from tests.llm import cases
from tests.llm.test_text_models import SF, brute_katz

FEW = [(i, t) for i, t in enumerate(["a b a b c", "A B c", "", "b b b new words here", "a b"] * 6)]


def many_words():
    """More distinct words than the 65,536 that once had an event of their own."""
    rng = np.random.default_rng(8)
    return [(i, " ".join(f"w{int(x)}" for x in 150_000 * rng.random(500) ** 1.3)) for i in range(400)]


@pytest.mark.parametrize("make", [None, cases, FEW, many_words])
def test_scores_over_all_words_equal_brute_force(spark, make):
    if make is None:
        docs = documents(spark, SF)
    elif make is cases:
        docs = cases.frame(spark)
    else:
        docs = spark.createDataFrame(make if isinstance(make, list) else make(), "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5))
                 for r in katz.score(docs).collect())
    want = brute_katz(rows, 10 ** 9)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=2e-5)
