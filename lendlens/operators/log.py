"""Prediction log: append, scan, pages, statistics, lookups.

The log is an append-only Parquet table partitioned by ``log_date`` so
time filters prune partitions and the rest are pushed into the scan.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.operators.rank import written

LOG_SCHEMA = ("id long, application_id string, timestamp timestamp_ntz, submitted_by string, applicant_name string, "
              "applicant_age int, applicant_income double, gender string, race string, loan_amount double, loan_term int, "
              "loan_purpose string, prediction string, probability double, confidence double, nlp_features string, "
              "extracted_entities string, shap_values string, adverse_action_reasons string, documents_uploaded string")


def to_log_schema(scored: DataFrame) -> DataFrame:
    """The log's columns in order, cast to its types; columns that are missing become null."""
    fields = [f.split(" ") for f in LOG_SCHEMA.split(", ")]
    return scored.select(*[(F.col(n) if n in scored.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def append_log(scored: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append scored rows to the log, in the log's schema, partitioned by day and run.

    An application id is logged once: ids that other runs have logged are left out, and of a run's rows with one
    id the first by time, then id, stays (rows without an id are all logged). The rows are written aside first and then
    replace the partitions of ``run_id``, so a job that is run again under the same id, after a failure or not, leaves one copy of its rows.
    Without a ``run_id`` every call is a run of its own."""
    spark, run = scored.sparkSession, run_id or uuid.uuid4().hex
    rows = to_log_schema(scored).withColumn("log_date", F.to_date("timestamp"))
    known = _logged(spark, path)
    if known is not None:
        rows = rows.join(known.filter(F.col("run") != run).select("application_id").distinct(), "application_id", "left_anti").select(*rows.columns)
    order = F.struct(F.col("timestamp"), F.col("id"), F.xxhash64(*rows.columns))
    first = rows.filter("application_id IS NOT NULL").groupBy("application_id").agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")
    staged = written(first.unionByName(rows.filter("application_id IS NULL")), "log-run")
    staged.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("log_date", "run").parquet(path)


def _logged(spark: SparkSession, path: str) -> DataFrame | None:
    """The log with its runs, or None before its first row."""
    try:
        schema = f"{LOG_SCHEMA}, log_date date, run string"
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_log(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Read the log; ``since`` prunes partitions and is pushed to Parquet."""
    df = spark.read.schema(f"{LOG_SCHEMA}, log_date date, run string").parquet(path).drop("run")
    if since is not None:
        ts = F.lit(since).cast("timestamp_ntz")
        df = df.filter((F.col("log_date") >= F.to_date(ts)) & (F.col("timestamp") >= ts))
    return df


def search(df: DataFrame, decision: str | None = None, text: str | None = None) -> DataFrame:
    """Decision equality and ILIKE search on applicant name or application id."""
    if decision:
        df = df.filter(F.col("decision") == decision)
    if text:
        pat = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        df = df.filter(F.col("applicant_name").ilike(pat) | F.col("application_id").ilike(pat))
    return df


MAX_PAGE = 1000


def _page_size(limit: int) -> int:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}, got {limit}")
    return limit


def log_page(df: DataFrame, decision=None, text=None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Newest first (id breaks ties), offset + limit. A limit outside 1..1000 is an
    error. A deep offset sorts all rows before it; ``log_page_after`` does not."""
    return search(df, decision, text).orderBy(F.desc("timestamp"), F.desc("id")).offset(offset).limit(_page_size(limit))


def log_page_after(df: DataFrame, after: tuple | None = None, decision=None, text=None, limit: int = 100) -> DataFrame:
    """S1, keyset form: the page that follows the row (timestamp, id) ``after``; the
    filter reaches the scan, so page number 10,000 costs as much as page 1."""
    rows = search(df, decision, text)
    if after is not None:
        ts, last = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
        rows = rows.filter((F.col("timestamp") <= ts) & ((F.col("timestamp") < ts) | (F.col("id") < last)))
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(_page_size(limit))


def log_total(df: DataFrame, decision=None, text=None) -> DataFrame:
    return search(df, decision, text).agg(F.count(F.lit(1)).alias("total"))


def most_recent(df: DataFrame, n: int = 50) -> DataFrame:
    """The n newest rows (top-k; Spark plans TakeOrderedAndProject)."""
    return df.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def latest(df: DataFrame) -> DataFrame:
    """Latest prediction time and id, one aggregate."""
    return df.agg(F.max("timestamp").alias("last_prediction_time"),
                  F.max_by("id", F.struct("timestamp", "id")).alias("last_id"))


def operating_stats(df: DataFrame, as_of) -> DataFrame:
    """Totals, today, last 7 days, approval / denial %, average amount, last time
    -- one aggregate instead of six queries. Rates are null on an empty log."""
    now = F.lit(as_of).cast("timestamp_ntz")
    today = F.date_trunc("day", now)
    week = now - F.make_interval(days=F.lit(7))
    agg = df.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("timestamp") >= today).alias("predictions_today"),
        F.count_if(F.col("timestamp") >= week).alias("predictions_this_week"),
        F.count_if(F.col("decision") == "approved").alias("_approved"),
        F.avg("loan_amount").alias("_avg_amount"),
        F.max("timestamp").alias("last_prediction_time"),
    )
    total = F.col("total_predictions")
    rate = F.when(total > 0, F.round(F.col("_approved") * 100.0 / total, 2))
    return agg.select(
        "total_predictions", "predictions_today", "predictions_this_week",
        rate.alias("approval_rate"),
        F.when(total > 0, F.round(100.0 - F.col("_approved") * 100.0 / total, 2)).alias("denial_rate"),
        F.round(F.coalesce(F.col("_avg_amount"), F.lit(0.0)), 2).alias("avg_loan_amount"),
        "last_prediction_time",
    )


def lookup(df: DataFrame, ids: DataFrame, key: str = "application_id") -> DataFrame:
    """J3 (batch form): rows whose key is in ``ids`` -- a left-semi join."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def missing(ids: DataFrame, df: DataFrame, key: str = "application_id") -> DataFrame:
    """Requested keys with no logged prediction -- a left-anti join."""
    return ids.select(key).distinct().join(df.select(key), key, "left_anti")


def decode_payloads(df: DataFrame) -> DataFrame:
    """Log JSON text -> typed columns (map, struct, arrays)."""
    return df.withColumns({
        "nlp_features": F.from_json("nlp_features", "map<string,double>"),
        "extracted_entities": F.from_json("extracted_entities", "map<string,string>"),
        "shap_values": F.from_json("shap_values",
                                   "struct<feature_names:array<string>,shap_values:array<double>,base_value:double>"),
        "adverse_action_reasons": F.from_json("adverse_action_reasons", "array<string>"),
        "documents_uploaded": F.split("documents_uploaded", ","),
    })
