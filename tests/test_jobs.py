"""Jobs, I/O round trips and permutation Shapley invariants."""

import math
import tempfile

from pyspark.sql import functions as F

from lendlens.operators import explain as XP
from lendlens.operators import log as LG
from lendlens.operators import metrics as ME
from lendlens.operators import model as MD
from lendlens.plans import jobs as J
from lendlens.sources import io as IO
from lendlens.sources import tables as TB

SF01 = "/root/testdata/sf0.01"


def test_log_append_and_scan(spark):
    path = tempfile.mkdtemp(prefix="lendlens-log-") + "/log"
    log = ME.decisions(TB.prediction_log(spark, "/root/testdata/sf0.001"))
    LG.append_log(log, path)
    back = LG.scan_log(spark, path, since="2024-01-20 00:00:00")
    want = log.filter(F.col("timestamp") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).count()
    assert back.count() == want
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan


def test_csv_round_trip(spark):
    path = tempfile.mkdtemp(prefix="lendlens-csv-") + "/apps"
    df = spark.createDataFrame([("A1", 30, None)], "application_id string, age int, employment_length double")
    IO.write(df, path, fmt="csv")
    back = IO.read_csv(spark, path, schema=df.schema)
    assert back.collect() == df.collect()


def test_train_and_batch_predict(spark):
    s = TB.scored_population(spark, SF01).drop("probability")
    model, metrics, test = J.train_job(s, "application_id", "label", ["n_chars", "toxic"], ["lang"], maxIter=5)
    assert 0.0 <= metrics["auc_roc"] <= 1.0
    apps = test.withColumns({"credit_score": F.lit(700), "age": F.lit(30), "loan_amount": F.lit(1000.0),
                             "loan_term": F.lit(36)})
    out = J.batch_prediction_job(model, apps, ["n_chars", "toxic", "lang"])
    assert out.filter(F.col("decision").isNull()).count() == 0
    assert out.count() == test.count()


def test_permutation_shapley_efficiency(spark):
    s = TB.scored_population(spark, SF01).drop("probability")
    train = MD.class_weight_column(s)
    model = MD.gbt_pipeline(["n_chars", "toxic"], [], weight_col="weight", maxIter=5).fit(train)
    rows = s.orderBy(F.desc("application_id")).limit(5)
    bg = s.orderBy("application_id").limit(10)
    phi = XP.permutation_shapley(rows, model, ["n_chars", "toxic"], bg, n_permutations=3, n_background=1)
    bg = bg.orderBy(F.xxhash64(F.col("n_chars").cast("double"), F.col("toxic").cast("double"), F.lit(42)), "n_chars", "toxic").limit(1)
    tot = {r.application_id: r.s for r in phi.groupBy("application_id").agg(F.sum("phi").alias("s")).collect()}
    fx = {r.application_id: r.default_probability for r in MD.predict(model, rows).collect()}
    fbg = sum(r.default_probability for r in MD.predict(model, bg).collect())
    for k, v in tot.items():
        assert math.isclose(v, fx[k] - fbg, abs_tol=1e-9)
