"""Exact dedup as a stateful stream.

Arrivals (digest, id, locator) are streamed into keyed state: per digest the row to keep and a
count, in RocksDB state stores on the executors' disks with their log in the shared checkpoint
folder, without watermark or expiry.  A digest that the state already knows is a hit; texts of hits
are compared byte for byte before any of them counts as a copy, texts of earlier batches too: their
locators (file, row in the file) lead back to the content.  Further ``ingest`` calls continue the same state.
A locator also tells rows apart that share an id.  It is taken from the file for a plain scan; the rows of any other
query are written first, since one file row may occur in it more than once.

Copies of one text may be a third of all rows.  Texts are compared by partial aggregates; for the join of rows with their
groups, groups that hold more than 1 / (4 * partitions) of all rows, of which there are fewer than that, are broadcast.

Defined results: a null text equals the empty text; among equal texts the row with the largest id
stays (null ids are smallest; of repeated rows of one id the last by locator); every row counts in
group_size; an empty table gives no rows; other columns play no part; texts of any length are compared whole.
DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakfree.llm.common import shared_path, shuffle_partitions, unpacked, whole, written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State on disk, and each task closes its store when it has committed: an executor's disk and memory hold
#: open tasks' stores only.  The durable copy is in the shared folder.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
LOCATOR = "struct<file:string,row:bigint>"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


#: Plans in which every row of a file occurs once at most.
PLAIN = {"LogicalRelation", "Relation", "Project", "Filter", "SubqueryAlias", "View"}


def _plain_scan(docs: DataFrame) -> bool:
    """A scan of files with nothing but projections and filters above it."""
    todo = [docs._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in PLAIN or node.children().size() > 1:
            return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return True


def located(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, body, locator and the packed row of a file-backed table (others are written first)."""
    try:
        docs.select("_metadata.row_index")
        plain = _plain_scan(docs)
    except Exception as e:  # not a file scan: there is no content to point to yet
        if "_metadata" not in str(e):
            raise
        plain = False
    if not plain:
        docs = written(docs, "dedup-content")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(row, place.alias("locator")).select(
        "_row", "locator", F.col("_row").getField(doc_id).alias("doc_id"),
        whole(F.col("_row").getField(text)).alias("body"))


class DedupStore:
    """Keyed state in ``path`` (a folder that all executors share)."""

    def __init__(self, spark: SparkSession, path: str | None = None, digest=sha256, text: str = "text"):
        self.spark, self.path, self.digest, self.text = spark, path or shared_path(spark, "dedup"), digest, text
        self.batch = ""

    @property
    def arrivals(self) -> str:
        return f"{self.path}/arrivals"

    def ingest(self, contents: DataFrame) -> None:
        """Append a batch of ``located`` rows to the arrivals and run the stream over what is new."""
        self.batch = uuid.uuid4().hex
        rows = contents.select(self.digest(F.col("body")).alias("digest"), "doc_id", "locator", F.lit(self.batch).alias("batch"))
        rows.write.mode("append").parquet(self.arrivals)
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in STATE_CONF}
        for k, v in STATE_CONF.items():
            conf.set(k, v)
        try:
            news = self.spark.readStream.schema(rows.schema).parquet(self.arrivals)
            (self.state_of(news).writeStream.outputMode("update").format("noop")
             .option("checkpointLocation", f"{self.path}/stream").trigger(availableNow=True)
             .start().awaitTermination())
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    @staticmethod
    def state_of(arrivals: DataFrame) -> DataFrame:
        return arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"),
                                              F.count(F.lit(1)).alias("n"))

    def seen(self) -> DataFrame:
        """The arrivals so far."""
        return self.spark.read.parquet(self.arrivals)

    def content(self, rows: DataFrame) -> DataFrame:
        """The bodies that rows of earlier batches point to: digest, doc_id, locator, body."""
        files = [r[0] for r in rows.select("locator.file").distinct().collect()]  # a part of the files that were read
        if not files:
            return rows.withColumn("body", F.lit("")).limit(0)
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        bodies = self.spark.read.parquet(*files).select(place.alias("_at"), whole(f"`{self.text}`").alias("body"))
        return rows.join(bodies, F.col("locator") == F.col("_at")).select("digest", "doc_id", "locator", "body")

    def state(self) -> DataFrame:
        """digest, keep (doc_id, locator), n: read from the state stores of the last commit."""
        s = self.spark.read.format("statestore").load(f"{self.path}/stream")
        keep, n = s.schema["value"].dataType.names
        return s.select(F.col("key.digest").alias("digest"), F.col(f"value.`{keep}`").alias("keep"),
                        F.col(f"value.`{n}`").alias("n"))


def groups(contents: DataFrame, store: DedupStore) -> DataFrame:
    """Per row of ``contents``, which ``store`` has ingested last: doc_id, locator, digest, keep (struct), n.
    Hits are verified on full texts."""
    state = written(store.state(), "dedup-state")
    seen = store.seen()
    mine = seen.where(F.col("batch") == store.batch).drop("batch")
    earlier = seen.where(F.col("batch") != store.batch).drop("batch")
    hits = state.where("n > 1").select(F.col("digest").alias("_d"))
    bodies = contents.select(store.digest(F.col("body")).alias("digest"), "doc_id", "locator", "body")
    bodies = bodies.join(hits, F.col("digest") == F.col("_d"), "left_semi")
    if not earlier.isEmpty():
        known = mine.select(F.col("digest").alias("_d")).distinct()
        back = written(earlier.join(known, F.col("digest") == F.col("_d"), "left_semi"), "dedup-hits")
        bodies = bodies.unionByName(store.content(back))
    # smallest and largest text of a digest are equal only if all its texts are; partial on the map side
    span = bodies.groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
    clash = written(span.where("lo != hi").select(F.col("digest").alias("_d")), "dedup-clash")
    if clash.isEmpty():
        return _grouped(mine, state)
    # one digest, several texts: those rows are grouped by the text itself
    fine = bodies.join(clash, F.col("digest") == F.col("_d"), "left_semi")
    per_text = fine.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "locator")).alias("keep"),
                                                  F.count(F.lit(1)).alias("n"))
    per_text = per_text.withColumnsRenamed({"digest": "_d", "body": "_b"})
    split = fine.join(per_text, (F.col("digest") == F.col("_d")) & (F.col("body") == F.col("_b"))).select(
        "digest", "doc_id", "locator", "keep", "n")
    split = split.join(mine.select(F.col("locator").alias("_at")), F.col("locator") == F.col("_at"), "left_semi")
    return _grouped(mine.join(clash, F.col("digest") == F.col("_d"), "left_anti"), state).unionByName(split)


def _grouped(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with their digest's group.  Large groups are broadcast: there are fewer than 4 * partitions of them."""
    s = state.withColumnRenamed("digest", "_d")
    most = (s.agg(F.sum("n")).first()[0] or 0) / (4 * shuffle_partitions(rows.sparkSession))
    large = F.broadcast(s.where(F.col("n") > most).select("_d"))
    on = F.col("digest") == F.col("_d")
    hot = rows.join(F.broadcast(s.where(F.col("n") > most)), on).drop("_d")
    return rows.join(large, on, "left_anti").join(s.where(F.col("n") <= most), on).drop("_d").unionByName(hot)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None,
          digest=sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest, locator."""
    contents = located(docs, text, doc_id)
    store = DedupStore(docs.sparkSession, path, digest, text)
    store.ingest(contents)
    g = groups(contents, store)
    return g.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                    (F.col("locator") == F.col("keep.locator")).alias("kept"), "digest", "locator")


def keep(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Filtering form: the rows that stay, with their own columns only."""
    contents = located(docs, text, doc_id)
    store = DedupStore(docs.sparkSession, text=text)
    store.ingest(contents)
    gone = groups(contents, store).where("locator != keep.locator").select(F.col("locator").alias("_gone"))
    return unpacked(contents.join(gone, F.col("locator") == F.col("_gone"), "left_anti"), docs.columns)
