"""The pipeline's rows, stage by stage, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from leakfree.llm.tokens import tokenizer_path
from tests.llm import cases
from tests.llm.test_dedup_and_rules import brute_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(text):
    """The current policy: few words, repeats, symbols, repeated lines, word lengths."""
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeats = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    chars = sum(map(len, w))
    return not (len(w) < 50 or 100 * len(repeats) > 50 * len(w) or len(re.findall(r"[#*$%&|<>]", text)) > len(w)
                or (lines and 100 * (len(lines) - len(set(lines))) > 50 * len(lines)) or chars < 2 * len(w) or chars > 20 * len(w))


def corpus():
    r = random.Random(12)
    out = [x[:5] for x in cases.rows() if len((x[1] or "").split()) < 3000]
    vocab = [f"word{i}" for i in range(3000)]
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(60, 300))]
        out.append((100 + i, " ".join(w), "en", ["a", "b", None, "d"][i % 4], 1))
        if i % 5 == 0:
            out.append((300 + i, " ".join(w), "en", "a", 1))
        if i % 7 == 0:
            w[r.randrange(len(w))] = "other"
            out.append((400 + i, " ".join(w), "en", "b", 1))
    return out


def test_every_stage_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = corpus_pipeline.documents(spark, str(tmp_path)), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs.collect())
    quality, exact, near, mix, pieces = kept
    assert all(set(k[0].__fields__) == {"doc_id", "text", "lang", "source", "n_chars"} for k in kept[:4])

    want = [x for x in rows if good(x[1])]
    assert Counter(map(tuple, quality)) == Counter(want) and len(want) < len(rows)
    best = {}
    for x in want:
        if x[1] not in best or (x[0] is not None, x[0]) > (best[x[1]] is not None, best[x[1]]):
            best[x[1]] = x[0]
    assert Counter((x.text, x.doc_id) for x in exact) == Counter(best.items()) and len(exact) < len(quality)

    classes = brute_classes([(i, x.text) for i, x in enumerate(exact)])
    of = {}
    for c in classes if not isinstance(classes, dict) else classes.values():
        for i in c:
            of[exact[i].text] = frozenset(exact[j].text for j in c)
    assert len({of[x.text] for x in near}) == len(near) == len(set(of.values())) < len(exact)

    size = lambda x: len(WORD.findall(x.text))
    total, before = defaultdict(int), Counter(x.text for x in near)
    for x in near:
        total[x.source] += size(x)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= level * weight[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = defaultdict(int)
    for x in mix:
        taken[x.source] += size(x)
    assert all(n <= 2 * before[t] for t, n in Counter(x.text for x in mix).items())
    most = max(map(size, near))
    assert all(abs(taken[s] - target[s]) <= most for s in order)

    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for x in mix:
        ids = [*tok.encode(x.text, add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s:s + 2048]
            want[(x.doc_id, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in pieces) == want
    assert Counter(x.length for x in pieces if x.sequence_id is None) == Counter()


def test_run_equals_its_stages_and_takes_nothing(spark, tmp_path):
    empty = cases.empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
