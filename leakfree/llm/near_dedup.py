"""Near dedup of word-shingle multisets by BagMinHash signatures.

A document is the multiset of its five-word shingles (a shorter text: one shingle of all its
words); two are near copies if the multisets' Jaccard similarity is 0.8 or more.

1. Documents with the same words in the same order are one node (grouped by digest, so that large
   groups of copies shrink before any shuffle of theirs).
2. BagMinHash: each (shingle, weight interval) runs a Poisson process; a point has a time, one of m
   components and a place in the interval, and counts if the place is below the shingle's weight.  Intervals
   double in width, so a weight w costs about log2(w) processes; places halve an interval further.
   A component's value is its earliest counting point, and processes stop once their next
   point is later than all components' values.  Equal values have the probability of the
   weighted Jaccard similarity.
3. Bands of ROWS components are bucket keys.  Each bucket's members are linked to its centre, the member that meets
   most others in its buckets (an original meets its copies more often than they meet each other); links
   are pre-filtered on sizes and on one bit per component, then verified on the whole multisets.
4. Connected components of the verified links.  A bucket whose members lie in several components then
   gets CENTRES other centres, of as many components, for the members of all its other components (those of the
   largest meet one of them), and one of the largest component; this is repeated with other centres while
   a turn joins many.  A turn is linear in the bucket entries: a cheap start that joins most components.
5. What the turns leave is compared whole: in a bucket whose members lie in several components, every pair
   of members of different components is dealt with.  The largest component and the other members are cut into blocks of
   about BLOCK by a hash; each pair of blocks (largest against others, others against others) is a group of its own, dealt
   over all tasks.  A pair passes by sizes, the one-bit sketch and the counts of its bags' hashes in CELLS cells, whose
   overlap bounds the bags' overlap from above, so that this filter loses nothing; the rest is verified once each.
   Pairs within a component aren't listed, since they can't change a class.

Defined results: a null text equals the empty text, and texts without words are copies of each other;
class_id is the smallest id that isn't null in a class; null ids and repeated rows are rows
like others; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakfree.llm.common import let, light_batches, ship, unpacked, word_array, written
from leakfree.llm.exact_dedup import located

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 30, 5
#: Of BANDS * ROWS one-bit values, so many must agree (expected 135 of 150 at similarity 0.8, deviation 3.7; fewer: 1.9e-7).
AGREE = 114
#: Centres a bucket gets in each turn after the first.
CENTRES = 8
#: A turn takes pairs with so many; it is a start only and may leave pairs to the blocks.
AGREE_TURN = 135
#: A turn with fewer links than this share of its verified pairs is the last; all pairs of blocks follow.
WORTH = 0.02
#: Mean members of a block of a split bucket, and cells of a bag's counts.
BLOCK, CELLS = 512, 512
#: Words that a task signs at once.
SLICE_WORDS = 100_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, xor, multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of all windows of ``size`` word hashes (one of all words if there are fewer)."""
    w = words.view(np.uint64)
    n = len(w)
    if not n:
        return w
    k = min(size, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix64(out + w[j:n - k + 1 + j] + GOLD)
    return out


def bag(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The multiset as a sorted set: the k-th equal shingle is mixed with k."""
    s = np.sort(shingles(words, size))
    if not len(s):
        return s
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    with np.errstate(over="ignore"):
        return np.sort(mix64(s + nth.astype(np.uint64) * GOLD))


def cells(bag: np.ndarray) -> bytes:
    """How many of a bag's hashes fall in each cell, up to 255."""
    at = (mix64(bag.view(np.uint64) + GOLD) % np.uint64(CELLS)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=CELLS), 255).astype(np.uint8).tobytes()


def bag_minhash(elements: list[np.ndarray], weights: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (times) of documents given as shingle hashes with whole weights of 1 or more."""
    n = len(elements)
    sig = np.full(n * m, np.inf)
    if not n:
        return sig.reshape(n, m)
    h = np.concatenate(elements)
    w = np.concatenate(weights).astype(np.int64)
    doc = np.repeat(np.arange(n), [len(e) for e in elements])
    seeds, widths, lows, docs, most = [], [], [], [], []
    level, low, width = 0, 0, 1
    live = np.ones(len(h), dtype=bool)
    while live.any():  # intervals (0, 1], (1, 2], (2, 4], (4, 8], ...
        with np.errstate(over="ignore"):
            seeds.append(mix64(h[live] + np.uint64(2 * level + 1) * GOLD))
        widths.append(np.full(live.sum(), float(width)))
        lows.append(np.full(live.sum(), low))
        docs.append(doc[live])
        most.append(w[live])
        low, width, level = low + width, max(1, low + width), level + 1
        live = w > low
    seed, width, low, doc, w = map(np.concatenate, (seeds, widths, lows, docs, most))
    time, step = np.zeros(len(seed)), 0
    latest = np.full(n, np.inf)
    while len(seed):
        k = int(np.clip(200_000 // len(seed), 1, 64))
        with np.errstate(over="ignore"):
            r = mix64(seed[:, None] + (np.arange(step + 1, step + k + 1, dtype=np.uint64) * GOLD)[None, :])
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / width[:, None]
        t = np.cumsum(np.concatenate([time[:, None], gap], axis=1), axis=1)[:, 1:]
        q = mix64(r)
        place = low[:, None] + (((q >> np.uint64(32)).astype(np.float64) * 2.0 ** -32) * width[:, None]).astype(np.int64)
        ok = (place < w[:, None]) & (t <= latest[doc][:, None])
        part = ((q & np.uint64(0xFFFFFFFF)).astype(np.int64) * m) >> 32
        at = (doc * m)[:, None] + part
        np.minimum.at(sig, at[ok], t[ok])
        time, step = t[:, -1], step + k
        active = np.unique(doc)
        latest[active] = sig.reshape(n, m)[active].max(axis=1)
        stay = time <= latest[doc]
        seed, width, low, doc, w, time = (x[stay] for x in (seed, width, low, doc, w, time))
    return sig.reshape(n, m)


SIGNED = "n bigint, bands array<bigint>, bits array<bigint>"


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of a batch into (first row, rows) of SLICE_WORDS words at most, or one row."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_WORDS, side="right")) - 1)
        yield at, end - at
        at = end


def _signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Adds n (shingles), bands (keys) and bits (one-bit sketch) to rows with ``node`` and ``words``."""
    ship(docs.sparkSession)
    m = bands * rows
    names = [c for c in docs.columns if c != "words"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, length in _slices(np.asarray(batch.column("words").offsets)):
                part = batch.slice(at, length)
                col = part.column("words")
                flat, off = np.asarray(col.values), np.asarray(col.offsets)
                pairs = [np.unique(shingles(flat[a:b], size), return_counts=True) for a, b in zip(off[:-1], off[1:])]
                sig = bag_minhash([p[0] for p in pairs], [p[1] for p in pairs], m).view(np.uint64)
                with np.errstate(over="ignore"):
                    keys = np.zeros((len(pairs), bands), dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * GOLD
                    for j in range(rows):
                        keys = mix64(keys + sig[:, j::rows] + GOLD)
                    one = (mix64(sig) >> np.uint64(63)).astype(np.uint8)
                one = np.pad(one, ((0, 0), (0, -m % 64)))
                bits = np.packbits(one, axis=1, bitorder="little").view("<i8")
                total = [int(p[1].sum()) for p in pairs]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(total, pa.int64()),
                     pa.array([k if t else [] for k, t in zip(keys.view(np.int64).tolist(), total)], pa.list_(pa.int64())),
                     pa.array(bits.tolist(), pa.list_(pa.int64()))],
                    names=[*names, "n", "bands", "bits"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(sign, f"{schema}, {SIGNED}")


def _words(body: str):
    return F.transform(word_array(F.col(body)), lambda w: F.xxhash64(w))


def _node(body: str):
    return F.unhex(F.md5(F.array_join(word_array(F.col(body)), " ").cast("binary")))


def _plausible(a: str, b: str, similar: float, least: int):
    """Sizes and one-bit sketches allow the similarity."""
    agree = sum((F.bit_count(F.col(f"{a}_bits")[i].bitwiseXOR(F.col(f"{b}_bits")[i]))
                 for i in range((BANDS * ROWS + 63) // 64)), F.lit(0))
    return ((F.col(f"{a}_n") >= similar * F.col(f"{b}_n")) & (F.col(f"{b}_n") >= similar * F.col(f"{a}_n"))
            & (agree <= BANDS * ROWS - least))


def _bags(texts: DataFrame, size: int) -> DataFrame:
    """node, bag and its cells of rows with node and words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("words")
            flat, off = np.asarray(col.values), np.asarray(col.offsets)
            bags = [bag(flat[x:y], size).view(np.int64) for x, y in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bags, pa.list_(pa.int64())),
                                              pa.array(list(map(cells, bags)), pa.binary())], names=["node", "bag", "cells"])

    return texts.mapInArrow(make, "node binary, bag array<bigint>, cells binary")


def _verified(pairs: DataFrame, bags: DataFrame, similar: float) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose whole multisets are similar enough, as links of their components.
    Bags are sets of distinct hashes, so their overlap is that of two arrays."""
    one = bags.select(F.col("node").alias("_a"), F.col("bag").alias("ba"))
    two = bags.select(F.col("node").alias("_b"), F.col("bag").alias("bb"))
    both = pairs.join(one, F.col("a") == F.col("_a")).select("b", "la", "lb", "ba").join(
        two, F.col("b") == F.col("_b")).select("la", "lb", "ba", "bb")
    overlap = let(F.size(F.array_intersect("ba", "bb")), lambda n: n >= F.lit(similar) * (F.size("ba") + F.size("bb") - n))
    return both.where(overlap).select(F.col("la").alias("a"), F.col("lb").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for the nodes of the links (a, b): labels
    spread along links and jump along labels until none changes."""
    ends = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")), "labels")
    while True:
        by = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        heard = ends.join(by, F.col("a") == F.col("_n")).groupBy(F.col("b").alias("_n")).agg(F.min("_l").alias("_l"))
        spread = labels.join(heard, F.col("node") == F.col("_n")).select(
            "node", "label", F.least("label", "_l").alias("next"))
        new = written(spread.join(by, F.col("next") == F.col("_n")).select(
            "node", F.col("_l").alias("label"), (F.col("_l") != F.col("label")).alias("moved")), "labels")
        if new.where("moved").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after links between components (rows without a label are components of their own)."""
    found = components(links)
    to = found.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    known = labels.join(to, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
    return written(known.unionByName(found.join(labels.select("node"), "node", "left_anti")), "labels")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    l = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return members.join(l, F.col("node") == F.col("_n"), "left").withColumn(
        "label", F.coalesce("_l", "node")).drop("_n", "_l")


def _blocks(inside: DataFrame, split: DataFrame, bags: DataFrame) -> DataFrame:
    """Members of split buckets, a row for each pair of blocks they take part in: ``task`` (bucket and pair of
    blocks) and ``side`` (0 or 1; 2 for a block paired with itself)."""
    rows = inside.join(split, F.col("bucket") == F.col("_bucket")).withColumn("big", F.col("label") == F.col("main"))
    rows = rows.join(bags.select(F.col("node").alias("_n"), "cells"), F.col("node") == F.col("_n"))
    count = lambda k: F.ceil(F.col(k) / BLOCK)
    rows = rows.withColumn("at", F.pmod(F.xxhash64("node", F.lit("block")),
                                        F.when(F.col("big"), count("k_main")).otherwise(count("k_rest"))))
    each = lambda k: F.sequence(F.lit(0).cast("bigint"), count(k) - 1)
    pair = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    at = F.col("at")
    big = F.transform(each("k_rest"), lambda y: pair(0, at, y, F.lit(0)))
    rest = F.concat(F.transform(each("k_main"), lambda x: pair(0, x, at, F.lit(1))),
                    F.transform(each("k_rest"), lambda y: pair(1, F.least(at, y), F.greatest(at, y), F.when(
                        at == y, 2).when(at < y, 0).otherwise(1))))
    rows = rows.withColumn("t", F.explode(F.when(F.col("big"), big).otherwise(rest)))
    return rows.select(F.struct("bucket", "t.kind", "t.x", "t.y").alias("task"), F.col("t.side").alias("side"),
                       "node", "label", F.col("a_n").alias("n"), F.col("a_bits").alias("bits"), "cells")


def _met_in_blocks(blocks: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b, la, lb) of different components that may be similar, once each."""

    def compare(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        node, label = (np.array(table[c].to_pylist(), dtype=object) for c in ("node", "label"))
        of = np.unique(label, return_inverse=True)[1]
        n = np.asarray(table["n"]).astype(np.float64)
        bits = np.asarray(table["bits"].combine_chunks().flatten()).view(np.uint64).reshape(len(n), -1)
        cell = np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint8).reshape(len(n), -1)
        over = n - cell.sum(axis=1, dtype=np.int64)  # beyond 255 in a cell
        own = side[0] == 2
        i, j = (np.arange(len(n)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        found = [np.zeros((2, 0), np.int64)]
        for first in range(0, len(i), 64):
            x, y = i[first:first + 64, None], j[None, :]
            ok = (of[x] != of[y]) & (n[x] >= similar * n[y]) & (n[y] >= similar * n[x])
            r, c = np.nonzero(ok & (x < y) if own else ok)
            r, c = x[r, 0], j[c]
            close = np.bitwise_count(bits[r] ^ bits[c]).sum(axis=1, dtype=np.int64) <= BANDS * ROWS - AGREE
            r, c = r[close], c[close]
            both = np.minimum(cell[r], cell[c]).sum(axis=1, dtype=np.int64) + np.minimum(over[r], over[c])
            may = both >= similar * (n[r] + n[c] - both) - 1e-6
            found.append(np.stack([r[may], c[may]]))
        r, c = np.concatenate(found, axis=1)
        turned = node[r] > node[c]
        r, c = np.where(turned, c, r), np.where(turned, r, c)
        return pa.Table.from_arrays([pa.array(v.tolist(), pa.binary()) for v in (node[r], node[c], label[r], label[c])],
                                    names=["a", "b", "la", "lb"])

    # a pair may come from several buckets
    return blocks.groupBy("task").applyInArrow(compare, "a binary, b binary, la binary, lb binary").groupBy("a", "b").agg(
        F.min("la").alias("la"), F.min("lb").alias("lb"))


def classes(contents: DataFrame, similar: float = SIMILAR, size: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): doc_id, locator and node per row; node and label of the nodes in links."""
    light_batches(contents.sparkSession)
    base = contents.select("doc_id", "locator", "body")
    signed = written(_signed(base.select("doc_id", "locator", _node("body").alias("node"), _words("body").alias("words")),
                             size, BANDS, ROWS), "signatures")
    nodes = written(signed.groupBy("node").agg(F.max("n").alias("n"), F.max("bits").alias("bits"),
                                               F.max("bands").alias("bands")), "nodes")
    entry = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = entry.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    sizes = written(sizes.select(F.col("bucket").alias("_bucket"), "k"), "sizes")
    # a node's weight: how many it meets in its buckets; the original of a group of copies weighs most
    weight = entry.join(sizes, F.col("bucket") == F.col("_bucket")).groupBy(F.col("node").alias("_node")).agg(
        F.sum("k").alias("weight"))
    heavy = written(nodes.join(weight, F.col("node") == F.col("_node")).drop("_node"), "weights")
    member = heavy.select("node", "n", "bits", "weight", F.explode("bands").alias("bucket"))
    member = written(member.join(sizes, F.col("bucket") == F.col("_bucket")).drop("_bucket"), "members")
    centre = member.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n", "bits")).alias("c"))
    centre = written(centre.select(F.col("bucket").alias("_bucket"), F.col("c.node").alias("b"), F.col("c.n").alias("b_n"),
                                   F.col("c.bits").alias("b_bits")), "centres")
    shared = member.select("node", F.col("n").alias("a_n"), F.col("bits").alias("a_bits"), "bucket").join(
        centre, F.col("bucket") == F.col("_bucket"))
    # one bag per node that shares a bucket; partial aggregation shrinks groups of copies on the map side
    wanted = heavy.select(F.col("node").alias("_w"))
    texts = base.select(_node("body").alias("node"), "body").groupBy("node").agg(F.min("body").alias("body"))
    texts = texts.join(wanted, F.col("node") == F.col("_w"), "left_semi")
    bags = written(_bags(texts.select("node", _words("body").alias("words")), size), "bags")

    def linked(pairs: DataFrame, least: int) -> tuple[DataFrame, int]:
        """Links between the components of members and centres that are similar, and the number of pairs verified."""
        pairs = pairs.where((F.col("node") != F.col("b")) & _plausible("a", "b", similar, least))
        pairs = pairs.groupBy(F.col("node").alias("a"), "b").agg(F.min("label").alias("la"), F.min("b_label").alias("lb"))
        pairs = written(pairs, "pairs")
        return written(_verified(pairs, bags, similar), "links"), pairs.count()

    labels = components(linked(shared.withColumn("label", F.col("node")).withColumn("b_label", F.col("b")), AGREE)[0])
    # two members have met by now
    others = member.where("k > 2").select("node", F.col("n").alias("a_n"), F.col("bits").alias("a_bits"), "bucket")
    turn, worth = 0, True
    while True:
        turn += 1
        inside = written(_labelled(others, labels), "inside")
        parts = inside.groupBy("bucket", "label").agg(
            F.count(F.lit(1)).alias("k"),
            F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "a_n", "a_bits")).alias("first"))
        parts = written(parts, "parts")
        split = parts.groupBy(F.col("bucket").alias("_bucket")).agg(
            F.count(F.lit(1)).alias("parts"), F.sum("k").alias("k"), F.max(F.struct("k", "label")).alias("top"))
        split = written(split.where("parts > 1").select("_bucket", F.col("top.label").alias("main"), F.col("top.k").alias("k_main"),
                                                        (F.col("k") - F.col("top.k")).alias("k_rest")), "split")
        if not worth:
            break
        few = Window.partitionBy("_bucket", "in_main").orderBy("first")  # with the limit: the first few of each map task
        new = parts.join(split, F.col("bucket") == F.col("_bucket")).withColumn("in_main", F.col("label") == F.col("main"))
        new = new.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= CENTRES)
        new = written(new.select("_bucket", "main", F.col("label").alias("b_label"), "nth", F.col("first.node").alias("b"),
                                 F.col("first.a_n").alias("b_n"), F.col("first.a_bits").alias("b_bits")), "centres")
        # the members of the largest component meet one centre only
        meet = inside.join(new, F.col("bucket") == F.col("_bucket"))
        more, verified = linked(meet.where("label != b_label AND (label != main OR nth = 1)"), AGREE_TURN)
        links = more.count()
        worth = links > WORTH * verified
        if links:
            labels = _joined(labels, more)
        others = inside.drop("label").join(split, F.col("bucket") == F.col("_bucket"), "left_semi")
    # every other pair of different components
    rest = written(_met_in_blocks(_blocks(inside, split, bags), similar), "pairs")
    rest = written(_verified(rest, bags, similar), "links")
    if not rest.isEmpty():
        labels = _joined(labels, rest)
    return signed.select("doc_id", "locator", "node"), labels


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR,
               size: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, kept, locator."""
    return _decided(located(docs, text, doc_id), similar, size)


def _decided(contents: DataFrame, similar: float, size: int) -> DataFrame:
    rows, labels = classes(contents, similar, size)
    rows = written(_labelled(rows, labels), "members")
    per = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
                                    F.min(F.struct("doc_id", "locator")).alias("keep"))
    per = written(per.withColumnRenamed("label", "_l"), "classes")
    return rows.join(per, F.col("label") == F.col("_l")).select(
        "doc_id", "class_id", "class_size", (F.col("locator") == F.col("keep.locator")).alias("kept"), "locator")


def keep(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR,
         size: int = WORDS) -> DataFrame:
    """Filtering form: one document of each class, with the caller's columns only."""
    contents = located(docs, text, doc_id)
    gone = _decided(contents, similar, size).where("NOT kept").select(F.col("locator").alias("_gone"))
    return unpacked(contents.join(gone, F.col("locator") == F.col("_gone"), "left_anti"), docs.columns)
