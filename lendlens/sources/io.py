"""Readers and writers.

Schemas are explicit; inference is opt-in. Writers never collect: reports
are written by the executors (``coalesce(1)`` only for reports that are
small by construction -- one row per group or metric).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

APPLICATION_SCHEMA = T.StructType([
    T.StructField("application_id", T.StringType()),
    T.StructField("applicant_name", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("annual_income", T.IntegerType()),
    T.StructField("employment_length", T.DoubleType()),
    T.StructField("sex", T.StringType()),
    T.StructField("race", T.StringType()),
    T.StructField("credit_score", T.IntegerType()),
    T.StructField("debt_to_income_ratio", T.DoubleType()),
    T.StructField("num_credit_lines", T.IntegerType()),
    T.StructField("num_derogatory_marks", T.IntegerType()),
    T.StructField("months_since_last_delinquency", T.DoubleType()),
    T.StructField("loan_amount", T.IntegerType()),
    T.StructField("loan_term", T.IntegerType()),
    T.StructField("loan_purpose", T.StringType()),
    T.StructField("interest_rate", T.DoubleType()),
    T.StructField("avg_monthly_balance", T.IntegerType()),
    T.StructField("num_overdrafts", T.IntegerType()),
    T.StructField("num_late_fees", T.IntegerType()),
    T.StructField("monthly_income_deposits", T.IntegerType()),
    T.StructField("loan_status", T.IntegerType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = APPLICATION_SCHEMA,
             header: bool = True, infer: bool = False, null_value: str = "NA") -> DataFrame:
    """A1: CSV with header; explicit schema unless ``infer``; ``NA`` read as null."""
    r = spark.read.option("header", header).option("nullValue", null_value)
    if infer or schema is None:
        r = r.option("inferSchema", True)
    else:
        r = r.schema(schema)
    return r.csv(path)


def write(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", partition_by=None) -> None:
    """A2: parquet / csv / json writer (csv with a header)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)


def write_report(report: DataFrame, path: str) -> None:
    """One CSV file with a header for a small report (metrics per group)."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_documents(spark: SparkSession, path: str, document_type: str | None = None) -> DataFrame:
    """A10: already-extracted text files, one document per file, keyed by file name."""
    df = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("document_id"),
        F.col("value").alias("raw_text"))
    return df.withColumn("document_type", F.lit(document_type)) if document_type else df
