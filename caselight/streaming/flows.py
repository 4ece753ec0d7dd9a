"""Streams: documents taken in once by content, the latest status of each case, balances checked in their turn."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.folders import shared_folder


def _finish(writer) -> None:
    """Run a stream over all that is there now, then end."""
    writer.trigger(availableNow=True).start().awaitTermination()


def new_contents(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """(content_key, n_chars, arrived) of texts (text, arrived) whose content is new, as a stream.

    The keys seen are the stream's own state, and are forgotten once the watermark is ``delay`` past them; no table of
    what was taken in is read. A null text is a content of its own, taken in once.
    """
    keyed = stream.select(F.sha2("text", 256).alias("content_key"), F.length("text").alias("n_chars"), F.col("arrived").cast("timestamp").alias("arrived"))
    return keyed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["content_key"])


def take_in(stream: DataFrame, taken: str, checkpoint: str, delay: str = "30 days") -> None:
    """Append what ``new_contents`` finds to the table ``taken``, with the smallest doc_id that each content has in its batch
    (null, if none has one or the stream has no such column). Each batch has a folder of its own there, which is written
    anew if the batch is run again after a failure."""
    number = F.col("doc_id").cast("long") if "doc_id" in stream.columns else F.lit(None).cast("long")
    new = new_contents(stream, delay).select("content_key", F.lit(None).cast("long").alias("doc_id"), "n_chars", "arrived", F.lit(True).alias("new"))
    all_rows = stream.select(F.sha2("text", 256).alias("content_key"), number.alias("doc_id"), F.length("text").alias("n_chars"), F.col("arrived").cast("timestamp").alias("arrived"), F.lit(False).alias("new"))

    def batch(rows: DataFrame, number: int) -> None:
        found = rows.groupBy("content_key").agg(F.max("new").alias("new"), F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars"), F.min("arrived").alias("arrived"))
        found.where("new").drop("new").write.mode("overwrite").parquet(f"{taken}/batch={number}")

    _finish(new.union(all_rows).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint))


def intake_of(docs: DataFrame, sf_dir: str) -> DataFrame:
    spark = docs.sparkSession
    taken = shared_folder(spark, "taken-in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*").withColumn("arrived", F.col("_metadata.file_modification_time"))
    take_in(stream, taken, shared_folder(spark, "intake-state"))
    return spark.read.schema("content_key string, doc_id long, n_chars int, arrived timestamp").parquet(taken)


def latest_status(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """(case_id, e): the newest event of each case so far, as a streaming aggregate in update mode."""
    steps = F.when(F.col("event_type") == "signup", 5).when(F.col("event_type") == "view", 30).when(F.col("event_type") == "click", 60).when(F.col("event_type") == "purchase", 100).otherwise(0)
    status = F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise("PROCESSING")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.col("user_id").alias("case_id")).agg(F.max(F.struct("ts", "event_id", steps.alias("progress"), status.alias("status"))).alias("e"))


def status_of(sf_dir: str, spark: SparkSession) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = shared_folder(spark, "status")
    stream = latest_status(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*"))

    def batch(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    _finish(stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", shared_folder(spark, "status-state")))
    last = spark.read.parquet(out).groupBy("case_id").agg(F.max("e").alias("e"))
    return last.select("case_id", "e.progress", "e.status")


CHECKED = "doc_id long, row_no int, kind string"
HELD = "doc_id long, at long, page int, row_no int, amount decimal(18,2), balance decimal(18,2)"
LAST = "doc_id long, balance decimal(18,2)"
STEP = Decimal("0.50")
#: Later than all dates, and within what pandas holds.
END = "2200-01-01"
#: The store that streams with states of several kinds need; balances are checked without it and leave the session's.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _of_batch(spark: SparkSession, path: str, schema: str, there: bool) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _forget(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def check_batch(rows: DataFrame, number: int, out: str, state: str, delay: str) -> None:
    """Check the rows that this batch lets go, and keep as state of the batch: the watermark, rows that are held back and
    the last balance of each statement. It reads the state of the batch before only, so that a batch that failed can run again.

    Rows are sorted by statement once, by Spark; a task holds no statement, and no row goes to Python.
    """
    spark, there, before, after = rows.sparkSession, number > 0, f"{state}/batch={number - 1}", f"{state}/batch={number}"
    old = _of_batch(spark, f"{before}/mark", "mark long", there).agg(F.max("mark").alias("mark")).first().mark
    timed = rows.where("txn_date IS NOT NULL").withColumn("at", F.unix_micros(F.col("txn_date").cast("timestamp")))
    newest = timed.agg(F.max("at").alias("at")).select(F.unix_micros(F.expr(f"timestamp_micros(at) - INTERVAL '{delay}'")).alias("mark")).first().mark
    mark = max((m for m in (old, newest) if m is not None), default=None)
    names = [c.split()[0] for c in HELD.split(", ")]
    pending = timed.where(F.lit(True) if old is None else F.col("at") > old).select(*names).unionByName(_of_batch(spark, f"{before}/held", HELD, there))
    late_enough = F.lit(False) if mark is None else F.col("at") <= mark
    pending.where(~late_enough).write.mode("overwrite").parquet(f"{after}/held")
    due = pending.where(late_enough).select("doc_id", F.lit(True).alias("new"), "page", "row_no", "amount", "balance")
    last = _of_batch(spark, f"{before}/last", LAST, there).select("doc_id", F.lit(False).alias("new"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("row_no"), F.lit(None).cast("decimal(18,2)").alias("amount"), "balance")
    turn = Window.partitionBy("doc_id").orderBy("new", "page", "row_no")
    was, amount, balance = F.lag("balance").over(turn), F.col("amount"), F.col("balance")
    kind = F.when(was.isNull() | amount.isNull(), None).when(F.abs(was - amount - balance) <= STEP, "debit").when(F.abs(was + amount - balance) <= STEP, "credit").otherwise("error")
    checked = due.unionByName(last).select("doc_id", "row_no", "new", kind.alias("kind"), F.when(F.lead("new").over(turn).isNull(), F.struct("balance")).alias("last"))
    checked.write.mode("overwrite").parquet(f"{after}/turn")
    checked = spark.read.schema(checked.schema).parquet(f"{after}/turn")
    checked.where("last IS NOT NULL").select("doc_id", "last.balance").write.mode("overwrite").parquet(f"{after}/last")
    checked.where("new").select("doc_id", "row_no", "kind").write.mode("overwrite").parquet(f"{out}/batch={number}")
    spark.createDataFrame([(mark,)], "mark long").write.mode("overwrite").parquet(f"{after}/mark")
    _forget(spark, f"{after}/turn")
    if number > 1:
        _forget(spark, f"{state}/batch={number - 2}")


def check_stream(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, delay: str = "1 day", files: int = 1000) -> None:
    """Check what has come to the folder ``source`` since the last call; ``end_stream`` lets the last rows go.

    ``out`` gets (doc_id, row_no, kind) of statement rows (doc_id, txn_date, page, row_no, amount, balance). Rows may come
    in any order and batches, as long as none is over ``delay`` behind the newest: later ones are dropped, as are rows
    without a date. A row is checked once the watermark has passed its date. Page and row number grow with the date.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    _finish(stream.writeStream.foreachBatch(lambda rows, number: check_batch(rows, number, out, f"{checkpoint}/turns", delay)).option("checkpointLocation", checkpoint))


def end_stream(spark: SparkSession, source: str, schema: StructType) -> None:
    """A row of no statement, so far ahead that the watermark passes all others."""
    end = spark.range(1).select(*(F.lit(END).cast(f.dataType).alias(f.name) if f.name == "txn_date" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
    end.write.mode("append").parquet(source)


def balances_of(rows: DataFrame) -> DataFrame:
    """All rows as a stream, in whatever order their files come."""
    spark = rows.sparkSession
    source, out, state = (shared_folder(spark, n) for n in ("statement-rows", "checked", "checked-state"))
    rows = rows.select("doc_id", "txn_date", "page", "row_no", "amount", "balance")
    rows.write.parquet(source)
    # All dates may come in the first batch, so none is late.
    check_stream(spark, source, rows.schema, out, state)
    end_stream(spark, source, rows.schema)
    check_stream(spark, source, rows.schema, out, state)
    return spark.read.schema(CHECKED).parquet(out).where("doc_id IS NOT NULL").drop("batch")
