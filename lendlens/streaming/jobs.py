"""Structured Streaming twins of the log jobs.

Streams read the event files incrementally, join static customer data,
score, and write through ``foreachBatch`` into Parquet folders under the
cluster's checkpoint folder. Windowed aggregates run in ``update`` mode and
each micro-batch appends its changed windows tagged with the batch id; the
final value of a window is its row from the highest batch id; in ``append``
mode a window appears once, when the watermark has closed it. With the
default of one micro-batch for the backlog, ``trigger(availableNow=True)`` gives
exactly the batch answer; smaller batches drop rows later than the watermark.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lendlens.operators import metrics as met
from lendlens.operators import model as mdl
from lendlens.session import ensure_checkpoint_dir
from lendlens.sources import tables as tb


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint folder (shared storage on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lendlens-{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The event table as a stream, whether it is one file or a folder of part files.

    By default the backlog is one micro-batch, so no row is late whatever the
    order of the files; with ``max_files_per_trigger`` the watermark drops rows
    that arrive more than its delay behind (``run_to_parquet`` counts them)."""
    reader = spark.readStream.schema(tb.table(spark, sf_dir, "events").schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{sf_dir}/events.parquet*")


def log_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """I4: events -> prediction-log rows with decisions (stream-static joins, stateless)."""
    e = event_stream(spark, sf_dir, max_files_per_trigger)
    c = tb.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = tb.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = tb.table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    log = (e.join(c, e.user_id == c.c_custkey, "left")
           .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
           .select(F.col("event_id").alias("id"),
                   F.concat(F.lit("APP"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("application_id"),
                   # event time must be TIMESTAMP (not _NTZ) for watermarks; session TZ is UTC
                   F.col("ts").cast("timestamp").alias("timestamp"), F.col("c_name").alias("applicant_name"),
                   F.col("c_mktsegment").alias("gender"), F.col("r_name").alias("race"),
                   (F.col("value") * 100).alias("loan_amount"),
                   F.least(F.col("value") / 500.0, F.lit(1.0)).alias("probability")))
    return met.decisions(log)


def score_stream(stream: DataFrame, model, columns: list[str], defaults: dict | None = None) -> DataFrame:
    """I4 with a fitted model: every row of the stream gets the model's probability and a decision."""
    stream = stream.drop("probability", "prediction", "decision", "confidence", "confidence_label")
    missing = {c: F.lit((defaults or {}).get(c, 0)) for c in columns if c not in stream.columns}
    scored = mdl.predict(model, stream.withColumns(missing) if missing else stream)
    return met.decisions(scored, prob="default_probability")


def ingest(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Validate, then drop repeated application ids seen within the watermark.

    A row needs an id, a time and a probability in [0, 1]; ``rejected`` gives the others."""
    return stream.filter(_valid()).withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["application_id"])


def rejected(stream: DataFrame) -> DataFrame:
    """The rows that ``ingest`` turns away."""
    return stream.filter(~_valid())


def _valid():
    return (F.col("application_id").isNotNull() & F.col("timestamp").isNotNull()
            & F.coalesce(F.col("probability").between(0.0, 1.0), F.lit(False)))


def windowed_stats(stream: DataFrame, window: str = "1 day", watermark: str = "1 day", slide: str | None = None) -> DataFrame:
    """Count, approval rate and average amount per tumbling window, or per sliding one with ``slide``.

    Run in ``update`` mode for the windows as they stand, in ``append`` mode for closed windows only."""
    return (stream.withWatermark("timestamp", watermark)
            .groupBy(F.window("timestamp", window, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("predictions"),
                 F.avg((F.col("decision") == "approved").cast("double")).alias("approval_rate"),
                 F.avg("loan_amount").alias("avg_loan_amount"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "predictions", "approval_rate", "avg_loan_amount"))


def windowed_group_rates(stream: DataFrame, attr: str = "gender", window: str = "1 day",
                         watermark: str = "1 day", slide: str | None = None) -> DataFrame:
    """Selection (approval) rate per window and group."""
    return (stream.withWatermark("timestamp", watermark)
            .groupBy(F.window("timestamp", window, slide).alias("w"), F.col(attr).alias("group"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("decision") == "approved").alias("approved"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "group", "n", "approved"))


class RunTotals(StreamingQueryListener):
    """Sums over every progress report of the runs it sees; a query keeps only its last hundred reports."""

    def __init__(self):
        self.input, self.dropped, self.batches, self.ended = {}, {}, {}, {}

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        run = str(p.runId)
        self.input[run] = self.input.get(run, 0) + p.numInputRows
        self.dropped[run] = self.dropped.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        self.batches[run] = self.batches.get(run, 0) + 1

    def onQueryTerminated(self, event):
        self.done(str(event.runId)).set()

    def done(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())


def run_counted(df: DataFrame, path: str, mode: str = "append", per_batch=None) -> dict[str, int]:
    """Run a stream to completion over the data present now (availableNow) and write it under ``path``.

    Every batch owns a folder named by its id and overwrites it, so a batch that is run again
    after a failure leaves its rows once. ``per_batch`` turns a batch into the rows to write. Returns, over all
    batches of the run however many, ``input`` rows read, rows ``dropped`` behind the watermark as the state operators report
    them (an aggregate reports partial groups) and ``batches``. With no aggregate, dropped is exact; ``late_rows`` is exact for aggregates."""
    out, ckpt = path + "/data", path + "/_checkpoint"
    spark, totals = df.sparkSession, RunTotals()

    def write(batch: DataFrame, batch_id: int):
        rows = per_batch(batch) if per_batch else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    spark.streams.addListener(totals)
    try:
        q = (df.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
             .foreachBatch(write).trigger(availableNow=True).start())
        q.awaitTermination()
        run = str(q.runId)
        totals.done(run).wait(60)  # reports arrive in order, the end last
    finally:
        spark.streams.removeListener(totals)
    return {k: getattr(totals, k).get(run, 0) for k in ("input", "dropped", "batches")}


def run_to_parquet(df: DataFrame, path: str, keys: list[str] | None = None, mode: str = "append") -> int:
    """``run_counted``, returning the dropped rows alone. With ``keys`` the latest version per key can be read back."""
    return run_counted(df, path, mode)["dropped"]


def late_rows(counted: DataFrame, totals: dict[str, int], n: str = "predictions") -> int:
    """How many input rows no window counts, after a run in ``update`` mode over tumbling windows: those behind the
    watermark when they came, and those without a time."""
    return totals["input"] - (counted.agg(F.sum(n)).first()[0] or 0)


def closed_group_gaps(stream: DataFrame, path: str, attr: str = "gender", window: str = "1 day", watermark: str = "1 day",
                      slide: str | None = None) -> dict[str, int]:
    """I3 per closed window: a window's groups leave the state together once the watermark has
    passed its end, and the batch that brings them computes both parity definitions. Windows still open are not
    written. Returns the run's totals; ``read_final`` reads the rows."""
    return run_counted(windowed_group_rates(stream, attr, window, watermark, slide), path, "append", analyze_group_gaps)


def read_final(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path + "/data")
    if not keys:
        return df.drop("batch_id")
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))  # one window/key's versions per partition
    return df.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk", "batch_id")


def analyze_group_gaps(rates: DataFrame) -> DataFrame:
    """I3 (closing step): per window, overall rate and max |group - overall| gap."""
    w = Window.partitionBy("window_start")  # one window's groups
    tot_n, tot_a = F.sum("n").over(w), F.sum("approved").over(w)
    g = rates.withColumns({"rate": F.col("approved") / F.col("n"), "overall_rate": tot_a / tot_n})
    return g.withColumns({"max_gap_to_overall": F.max(F.abs(F.col("rate") - F.col("overall_rate"))).over(w),
                          "dp_difference": F.max("rate").over(w) - F.min("rate").over(w)})
