"""Language-model scores by Katz backoff over words (order 2).

Tokens are lower-case (A-Z) words between white space, then one end per text.  The model's events
are all training words, the end, and one class for a word that training lacks, so the model is normalised
over the V training words and one unseen word, as the add-one base is.

    p(w | h) = d(c) c(h w) / D(h)        if h w occurs in training,  D(h) = c(h) + 0.5
             = alpha(h) p(w)             otherwise, alpha(h) = (1 - sum of the above) / (1 - sum of p(w))
    p(w)     = d1(c) c(w) / (N + 1), the rest goes to the unseen word

d are Good-Turing discounts for counts up to 5, from the counts of counts; sums in alpha run over the
words seen after h, so the weights are normalised exactly (a history after which every event has
been seen keeps its spare half count).

How it runs: words are 64-bit hashes, word counts a Spark aggregation over all training texts.  Documents are numbered by
task, batch and place.  A pair's occurrences (pair, document, count) are dealt by w, and pairs with a frequent w by
the whole pair; word counts are dealt alike and meet them there (frequent words go everywhere), so no table of words is
gathered or broadcast.  A bucket counts its pairs and tells, per document, what its pairs and words contribute.  Since
discounts are known only once all pairs are counted, a document's contribution is kept as its number of pairs with
c = 1..5 and a sum of logarithms for others; pairs that training lacks are kept as rows (document, h) and meet alpha(h)
by a join.

Defined results: a null text is the empty text (one end); null ids and repeated rows are scored row
by row; without training rows scores equal the base's; an empty table gives no rows; other columns play no part; texts are
scored whole, whatever their length; ids must cast to bigint.  Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakfree.llm.common import part_of, ship, shuffle_partitions, whole, word_array, written

FOLDS, HELD_OUT = 7, 2
CUT = 5
SPARE = 0.5
PER_BUCKET = 3_000_000
BATCH = 4096


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def discounts(n: list[float]) -> list[float]:
    """Good-Turing discount ratios for counts 1..CUT from counts of counts n[1..CUT + 1]
    (``n[0]`` unused); where they aren't usable, a half count is taken off."""
    out = [1.0] * (CUT + 1)
    common = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        d = 0.0
        if n[r] and common < 1:
            d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _weights(tally: DataFrame) -> tuple[list[float], DataFrame]:
    """Discounts of pairs, and the logarithms of alpha(h) and D(h) per history _h."""
    s = tally.agg(*[F.sum(f"n{r}") for r in range(1, CUT + 2)]).first()
    d = discounts([0.0, *[float(x or 0) for x in s]])
    mass = sum((F.col(f"n{r}") * (r * d[r]) for r in range(1, CUT + 1)), F.col("big"))
    total = sum((F.col(f"n{r}") * r for r in range(1, CUT + 1)), F.col("big")) + SPARE
    return d, tally.select("_h", F.log10((1 - mass / total) / F.greatest(1 - F.col("p"), F.lit(1e-12))).alias("alpha"),
                           F.log10(total).alias("total"))


#: Numbers of the start and the end among the words' hashes.
BEGIN, STOP = -0x6A09E667F3BCC909, -0x3C6EF372FE94F82B
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Blobs of a batch of documents.  A bucket below 0 has the documents' ids (words), which aren't null (pairs) and their tokens (histories).
HASHED = "bucket int, batch bigint, held binary, words binary, pairs binary, histories binary, docs binary, places binary, counts binary"
#: kind 0: document ``id``; 1: history ``id``; 2: pair of document ``id`` that training lacks, with its history; 3: document ``id``,
#: its doc_id as ``h`` and its tokens as ``k``.  A document's number is odd if it is held out.
STATS = ("kind int, id bigint, h bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, n5 bigint, n6 bigint, "
         "k bigint, value double, p double")


def _hashed(text):
    return F.transform(word_array(F.translate(text, UPPER, UPPER.lower())), lambda w: F.xxhash64(w))


def hash_counts(rows: DataFrame) -> DataFrame:
    """w, c over the training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, c = np.unique(np.asarray(batch.column(0).flatten()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(c, pa.int64())], names=["w", "c"])

    return rows.where("NOT held_out").select(_hashed(F.col("text")).alias("words")).mapInArrow(
        count, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def _give_back() -> None:
    """Hand freed memory back to the system: a worker that waits for its next task else keeps it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _packed(places: np.ndarray) -> bytes:
    """Places in a batch (12 bits each), two in three bytes; an odd one at the end takes two bytes."""
    n = len(places) // 2 * 2
    a, b = places[:n:2].astype(np.uint16), places[1:n:2].astype(np.uint16)
    out = np.stack([a & 255, a >> 8 | (b & 15) << 4, b >> 4], axis=1).astype(np.uint8)
    return out.tobytes() + places[n:].astype("<u2").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 3 * 3
    x = np.frombuffer(raw[:n], np.uint8).reshape(-1, 3).astype(np.int32)
    both = np.stack([x[:, 0] | (x[:, 1] & 15) << 8, x[:, 1] >> 4 | x[:, 2] << 4], axis=1).ravel()
    return np.concatenate([both, np.frombuffer(raw[n:], "<u2").astype(np.int32)])


def _dealt(h: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of pairs: by w, and by the pair where w is frequent."""
    with np.errstate(over="ignore"):
        pair = (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ w.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(np.isin(w, hot), ((pair >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64), w % buckets)


def hash_occurrences(rows: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Pairs of a batch of documents by bucket: its words in order with their numbers of pairs, the pairs' histories with
    their numbers of documents, the documents' places and counts."""
    names = [x.split()[0] for x in HASHED.split(", ")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                key, is_held, col = part.column(0), np.asarray(part.column(1).cast(pa.uint8())), part.column(2)
                off = np.asarray(col.offsets).astype(np.int64)
                flat = np.asarray(col.values)[off[0]:off[-1]]
                off = off - off[0]
                h, w = np.insert(flat, off[:-1], BEGIN), np.insert(flat, off[1:], STOP)
                place = np.repeat(np.arange(part.num_rows, dtype=np.uint16), np.diff(off) + 1)
                bucket = _dealt(h, w, hot, buckets).astype(np.int32)
                order = np.lexsort((h, w, bucket)).astype(np.int32)  # stable: places stay in order
                h, w, place, bucket = h[order], w[order], place[order], bucket[order]
                del flat, order
                entry = _starts(bucket, w, h, place)
                count = np.diff(np.append(entry, len(h)))
                h, w, place, bucket = h[entry], w[entry], place[entry], bucket[entry]
                pair = _starts(bucket, w, h)
                docs = np.diff(np.append(pair, len(h)))
                word = _starts(bucket[pair], w[pair])
                pairs = np.diff(np.append(word, len(pair)))
                held = is_held.tobytes()
                there = np.asarray(key.is_valid().cast(pa.uint8())).tobytes()
                sizes = (np.diff(off) + 1).astype("<u4").tobytes()
                out = [(-1 - (number >> 12) % buckets, number, held, np.asarray(key.fill_null(0)).astype("<i8").tobytes(), there, sizes, *[b""] * 3)]
                span = lambda b: np.searchsorted(b, np.arange(buckets + 1))
                of_entry, of_pair, of_word = span(bucket), span(bucket[pair]), span(bucket[pair][word])
                for b in range(buckets):
                    e, q, v = (slice(x[b], x[b + 1]) for x in (of_entry, of_pair, of_word))
                    if of_entry[b] < of_entry[b + 1]:
                        out.append((b, number, held, w[pair][word][v].tobytes(), pairs[v].astype("<u4").tobytes(), h[pair][q].tobytes(),
                                    docs[q].astype("<u2").tobytes(), _packed(place[e]), count[e].astype("<u4").tobytes()))
                number += BATCH
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                del out, h, w, place, bucket, entry, pair, word
                _give_back()

    return rows.select("doc_id", "held_out", _hashed(F.col("text")).alias("words")).mapInArrow(split, HASHED)


def _stats(kind: int, **columns) -> pa.Table:
    """Rows of STATS; columns that a kind lacks are null."""
    n = len(next(iter(columns.values())))
    out = {}
    for field in STATS.split(", "):
        name, what = field.split()
        to = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[what]
        out[name] = pa.array(columns[name], to) if name in columns else pa.array(np.full(n, kind, np.int32)) if name == "kind" else pa.nulls(n, to)
    return pa.table(out)


def hash_contributions(blobs: DataFrame, counts: DataFrame, n: int, types: int, d: list[float], unseen: float) -> DataFrame:
    """Rows of STATS.  A document's n1..n5 are its pairs by count, n6 its known tokens, p its base score, value
    the rest of its score but for discounts and backoff weights (D(h) taken off); a history's n1..n6 are the words after it by
    count, value the sum of larger counts, p the sum of p(w)."""
    d = np.array(d)

    def documents(row: dict) -> tuple[np.ndarray, np.ndarray]:
        held = np.frombuffer(row["held"], np.uint8)
        return (row["batch"] + np.arange(len(held))) * 2 + held, held

    def reduce(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _stats(0, id=[])
        word, hist, docs, doc, places, ks, keys, sizes, rows = [], [], [], [], [], [], [], [], 0
        for i in range(table.num_rows):  # a batch's bytes at a time
            r = {c: table[c][i].as_py() for c in table.column_names}
            doc.append(documents(r)[0])
            if r["bucket"] < 0:
                keys.append(pa.array(np.frombuffer(r["words"], "<i8"), mask=np.frombuffer(r["pairs"], np.uint8) == 0))
                sizes.append(np.frombuffer(r["histories"], "<u4"))
                continue
            word.append(np.repeat(np.frombuffer(r["words"], "<i8"), np.frombuffer(r["pairs"], "<u4")))
            hist.append(np.frombuffer(r["histories"], "<i8"))
            docs.append(np.frombuffer(r["docs"], "<u2"))
            places.append(_unpacked(r["places"]) + np.int32(rows))
            ks.append(np.frombuffer(r["counts"], "<u4").astype(np.int32))
            rows += len(doc[-1])
        doc = np.concatenate(doc)
        if keys:
            return _stats(3, id=doc, h=pa.concat_arrays(keys), k=np.concatenate(sizes))
        of = np.concatenate(places)
        word, hist, docs, k = map(np.concatenate, (word, hist, docs, ks))
        del places, ks
        order = np.lexsort((hist, word))
        first = _starts(word[order], hist[order])
        at = np.empty(len(word), dtype=np.int32)
        at[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(word))))
        at = np.repeat(at, docs)
        w, h = word[order][first], hist[order][first]
        del word, hist, order, docs
        kw, kc = np.asarray(known["w"]), np.asarray(known["c"])
        by = np.argsort(kw)
        kw, kc = np.append(kw[by], 0), np.append(kc[by], 0)
        near = np.searchsorted(kw[:-1], w)
        cw = np.where((kw[near] == w) & (near < len(kw) - 1), kc[near], 0)
        p = np.where(cw > 0, cw * np.where(cw <= CUT, d[np.minimum(cw, CUT)], 1.0) / (n + 1), unseen)
        c = np.bincount(at, np.where((doc & 1 == 1)[of], 0, k), minlength=len(w)).astype(np.int64)
        # documents
        ce, base = c[at], np.log10((cw + 1) / (n + types + 1))
        less = np.where(w == STOP, 0.0, np.log10(cw + SPARE))
        here = np.bincount(of, minlength=len(doc)) > 0
        add = lambda x: np.bincount(of, x, minlength=len(doc))[here]
        whole_ = lambda x: add(x).astype(np.int64)
        own = np.where(ce > CUT, np.log10(np.maximum(ce, 1)), np.where(ce == 0, np.log10(p)[at], 0.0)) - less[at]
        one = _stats(0, id=doc[here], **{f"n{r}": whole_(np.where(ce == r, k, 0)) for r in range(1, CUT + 1)},
                     n6=whole_(np.where((cw > 0)[at], k, 0)), value=add(k * own), p=add(k * base[at]))
        del own
        lack = ce == 0
        lost, gone, times = doc[of[lack]], at[lack], k[lack].astype(np.int64)
        del ce, lack, of, at, k
        three = _stats(2, id=lost, h=h[gone], k=times)
        # histories
        seen = c > 0
        hs, of = np.unique(h[seen], return_inverse=True)
        cs = c[seen]
        two = _stats(1, id=hs, **{f"n{r}": np.bincount(of, cs == r, minlength=len(hs)).astype(np.int64) for r in range(1, CUT + 2)},
                     value=np.bincount(of, np.where(cs > CUT, cs, 0), minlength=len(hs)).astype(np.float64),
                     p=np.bincount(of, p[seen], minlength=len(hs)))
        del p, c, w, h, seen
        out = pa.concat_tables([one, two, three])
        _give_back()
        return out

    return blobs.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(reduce, STATS)


def score(docs: DataFrame, folds: int = FOLDS, held: int = HELD_OUT) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; over all training words."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (part_of("doc_id", folds) == held).alias("held_out"),
                       whole("text").alias("text"))
    texts = rows.where("NOT held_out").count()
    counts = written(hash_counts(rows), "words")
    s = counts.agg(F.sum("c"), F.count(F.lit(1)), *[F.count_if(F.col("c") == r) for r in range(1, CUT + 2)]).first()
    n, types = (s[0] or 0) + texts, s[1] + (texts > 0)
    of = [0.0, *[float(x) for x in s[2:]]]
    if 1 <= texts <= CUT + 1:
        of[texts] += 1
    d1 = discounts(of)
    unseen = 1 - (n - sum(r * of[r] * (1 - d1[r]) for r in range(1, CUT + 1))) / (n + 1)
    buckets = max(shuffle_partitions(spark), math.ceil((n * folds / max(folds - 1, 1)) / PER_BUCKET))
    # frequent words: at most 8 a bucket
    hot = [r["w"] for r in counts.where(F.col("c") > n / buckets / 8).select("w").collect()] + [STOP]
    known = counts.unionByName(spark.createDataFrame([(STOP, texts)], "w bigint, c bigint"))
    everywhere = F.sequence(F.lit(0), F.lit(buckets - 1))
    known = known.withColumn("bucket", F.explode(F.when(F.col("w").isin(hot), everywhere).otherwise(
        F.array(F.pmod("w", F.lit(buckets)).cast("int")))))
    stats = written(hash_contributions(hash_occurrences(rows, np.array(hot, dtype=np.int64), buckets), known, n, types, d1, unseen),
                    "katz")
    tally = stats.where("kind = 1").groupBy(F.col("id").alias("_h")).agg(
        *[F.sum(f"n{r}").alias(f"n{r}") for r in range(1, CUT + 2)], F.sum("value").alias("big"), F.sum("p").alias("p"))
    d, alpha = _weights(written(tally, "histories"))
    never = math.log10(SPARE)  # a history without training pairs: its backoff weight is 1
    none, no = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    backoff = alpha.select("_h", (F.col("alpha") + F.col("total")).alias("weight"))
    lacking = stats.where("kind = 2").select("id", "h", "k").join(backoff, F.col("h") == F.col("_h"), "left").select(
        "id", (F.col("k") * F.coalesce("weight", F.lit(never))).alias("value"), none.alias("tokens"), none.alias("known"), no.alias("base"),
        none.alias("doc_id"))
    seen = sum((F.col(f"n{r}") * math.log10(r * d[r]) for r in range(1, CUT + 1)), F.col("value"))
    own = stats.where("kind = 0").select("id", seen.alias("value"), none.alias("tokens"), F.col("n6").alias("known"),
                                         F.col("p").alias("base"), none.alias("doc_id"))
    keys = stats.where("kind = 3").select("id", no.alias("value"), F.col("k").alias("tokens"), none.alias("known"), no.alias("base"),
                                          F.col("h").alias("doc_id"))
    out = own.unionByName(lacking).unionByName(keys).groupBy("id").agg(
        *[F.sum(c).alias(c) for c in ("value", "tokens", "known", "base")], F.max("doc_id").alias("doc_id"))
    return out.select("doc_id", (F.col("id").bitwiseAND(F.lit(1)) == 1).alias("held_out"), F.col("tokens").alias("n_tokens"),
                      F.col("known").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"),
                      (F.col("value") - math.log10(texts + SPARE) if n else F.col("base")).alias("score"))
