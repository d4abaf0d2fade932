"""Registered queries on long dictionaries, model attributions, exact ranks, oversampling, constrained search and closed windows."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import functions as F

from lendlens.operators import documents as dc
from lendlens.operators import mitigation as mit
from lendlens.operators import neighbours as nb
from lendlens.operators import rank
from lendlens.operators import tree_shap as ts
from lendlens.operators.rank import written
from lendlens.plans.catalog import LOG_SQL, SCORED_SQL, fit_document_model, register
from lendlens.plans.oracle_util import r, round_doubles
from lendlens.sources import tables as tb
from lendlens.streaming import jobs as sj

# ---------------------------------------------------------------------------
# G1: exact tree attributions
# ---------------------------------------------------------------------------
PLAYERS = ["n_chars", "toxic", "english"]
#: (weight, tree): a node is (feature number, threshold or list of categories, left, right)
TREES = [
    (1.0, (0, 800.0, (1, 0.5, 0.51, -0.23), (0, 3000.0, -0.11, 1.07))),
    (0.4, (1, 0.5, (0, 1500.0, 0.26, -0.74), (2, [0.0], 2.02, 0.53))),
    (0.8, (2, [1.0], (0, 400.0, (1, 0.5, -1.01, 3.03), (0, 5000.0, 0.48, (1, 0.5, 0.77, -2.04))), 0.13)),
]


def _tree_sql(node, cols) -> str:
    if isinstance(node, float):
        return repr(node)
    slot, rule, left, right = node
    test = f"{cols[slot]} <= {rule}" if isinstance(rule, float) else f"{cols[slot]} IN ({', '.join(map(str, rule))})"
    return f"CASE WHEN {test} THEN {_tree_sql(left, cols)} ELSE {_tree_sql(right, cols)} END"


def _attribution_sql() -> str:
    """Every coalition's value by averaging over the background's cells, then the weighted marginal contributions."""
    def value(coalition):
        cols = [f"x.{p}" if i in coalition else f"b.{p}" for i, p in enumerate(PLAYERS)]
        return "sum(b.n * (" + " + ".join(f"{w} * ({_tree_sql(t, cols)})" for w, t in TREES) + ")) / sum(b.n)"

    every = [c for k in range(4) for c in combinations(range(3), k)]
    name = {c: "v" + "".join(map(str, c)) for c in every}

    def phi(i):
        terms = [f"{factorial(len(c)) * factorial(2 - len(c))} * ({name[tuple(sorted((*c, i)))]} - {name[c]})" for c in every if i not in c]
        return "(" + " + ".join(terms) + ") / 6.0"

    return f"""
WITH {SCORED_SQL},
x AS (SELECT application_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(toxic AS DOUBLE) AS toxic, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS english FROM s),
b AS (SELECT CASE WHEN n_chars <= 400 THEN 400.0 WHEN n_chars <= 800 THEN 800.0 WHEN n_chars <= 1500 THEN 1500.0 WHEN n_chars <= 3000 THEN 3000.0
               WHEN n_chars <= 5000 THEN 5000.0 ELSE 1e9 END AS n_chars, toxic, english, count(*) AS n FROM x GROUP BY 1, 2, 3),
v AS (SELECT x.application_id, {', '.join(f'{value(c)} AS {name[c]}' for c in every)} FROM x, b GROUP BY x.application_id)
SELECT application_id, {r(name[()], 'base_value')}, {', '.join(r(phi(i), 'phi_' + p) for i, p in enumerate(PLAYERS))}, {r(name[0, 1, 2], 'margin')} FROM v
"""


@register("tree_attributions", _attribution_sql())
def q_tree_attributions(spark, sf_dir):
    """G1 on a fixed ensemble: every scored row's exact shares against the whole population as background."""
    s = tb.scored_population(spark, sf_dir)
    vector = F.array(F.col("n_chars").cast("double"), F.col("toxic").cast("double"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0))
    rows = s.select("application_id", vector.alias("vector"))
    trees = ts.ensemble([t for _, t in TREES], [w for w, _ in TREES], [0, 1, 2])
    found, base = ts.attributions(rows, rows, "vector", trees, PLAYERS)
    phi = [F.col("phi")[i].alias(f"phi_{p}") for i, p in enumerate(PLAYERS)]
    total = F.lit(base) + F.col("phi")[0] + F.col("phi")[1] + F.col("phi")[2]
    return round_doubles(found.select("application_id", F.lit(base).alias("base_value"), *phi, total.alias("margin")))


@register("gbt_tree_attributions", f"""
WITH {SCORED_SQL},
h AS (SELECT *, CASE WHEN CAST(('0x' || substr(md5(CAST(application_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT)
                     / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM s)
SELECT count(*) AS explained, count(*) AS efficient, 'lang,n_chars,source,toxic' AS features FROM h WHERE split = 'test'
""")
def q_gbt_tree_attributions(spark, sf_dir):
    """G1 on the fitted model: the shares of every test row and the base add up to its margin, one share per source column."""
    model, s = fit_document_model(spark, sf_dir)
    found, base = ts.tree_shapley(s.filter(F.col("split") == "test"), model, s.filter(F.col("split") == "train"))
    total = F.aggregate("contributions", F.lit(base), lambda a, c: a + c["phi"])
    return found.agg(F.count(F.lit(1)).alias("explained"), F.count_if(F.abs(total - F.col("margin")) < 1e-9).alias("efficient"),
                     F.max(F.array_join(F.array_sort(F.col("contributions.feature")), ",")).alias("features"))


# ---------------------------------------------------------------------------
# Exact stratified split and folds
# ---------------------------------------------------------------------------
RANK_SQL = f"""{SCORED_SQL},
k AS (SELECT application_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(application_id AS VARCHAR) || ':' || CAST(label AS VARCHAR) || ':42'),
        application_id) AS pos, count(*) OVER (PARTITION BY label) AS n FROM s)"""


@register("stratified_exact_split", f"""
WITH {RANK_SQL}
SELECT application_id, label, CASE WHEN pos <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM k
""")
def q_stratified_exact_split(spark, sf_dir):
    """B23 with exact class ratios."""
    s = tb.scored_population(spark, sf_dir)
    return rank.stratified_split(s, "application_id").select("application_id", "label", "split")


@register("stratified_folds", f"""
WITH {RANK_SQL}
SELECT application_id, label, CAST((pos - 1) % 5 AS INTEGER) AS fold FROM k
""")
def q_stratified_folds(spark, sf_dir):
    """F5 with equal folds per class."""
    s = tb.scored_population(spark, sf_dir)
    return rank.stratified_folds(s, "application_id").select("application_id", "label", "fold")


# ---------------------------------------------------------------------------
# Neighbours of the minority and synthetic rows between them
# ---------------------------------------------------------------------------
@register("minority_neighbours", f"""
WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label = 0),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
      FROM m a JOIN m b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS pos FROM d)
SELECT vec_id, CAST(pos AS INTEGER) AS rank, neighbour, {r('distance', 'distance')} FROM k WHERE pos <= 5
""")
def q_minority_neighbours(spark, sf_dir):
    """The five nearest minority rows of every minority row, over all components."""
    e = tb.table(spark, sf_dir, "embeddings").filter("label = 0")
    found = nb.neighbours(e, "vec_id", "embedding", 5)
    return round_doubles(found.select(F.col("id").alias("vec_id"), "rank", "neighbour", "distance"))


@register("synthetic_pairs", """
WITH c AS (SELECT count(*) FILTER (WHERE label <> 0) AS n0, count(*) FILTER (WHERE label = 0) AS n1 FROM embeddings)
SELECT n0 - n1 AS synthetic, n0 - n1 AS on_their_segment, n0 - n1 AS neighbour_is_near, n0 // n1 - 1 AS least, (n0 + n1 - 1) // n1 - 1 AS most FROM c
""")
def q_synthetic_pairs(spark, sf_dir):
    """every synthetic row lies between its own row and one of that row's five nearest, in all components."""
    e = tb.table(spark, sf_dir, "embeddings")
    n0, n1 = e.agg(F.count_if(F.col("label") != 0), F.count_if(F.col("label") == 0)).first()
    rows = e.filter("label = 0").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    made = written(nb.synthetic(rows, "id", "x", n0 - n1), "synthetic")
    near = nb.neighbours(rows, "id", "x", 5).select("id", "neighbour", F.lit(True).alias("is_near"))
    ends = made.join(rows, "id").join(rows.select(F.col("id").alias("neighbour"), F.col("x").alias("y")), "neighbour").join(near, ["id", "neighbour"], "left")
    off = F.aggregate(F.zip_with("vector", F.zip_with("x", "y", lambda a, b: a + F.col("u") * (b - a)), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: F.greatest(a, v))
    counted = ends.groupBy("id").agg(F.count("*").alias("n"), F.count_if(off < 1e-9).alias("on_segment"), F.count_if("is_near").alias("near"))
    return counted.agg(F.sum("n").alias("synthetic"), F.sum("on_segment").alias("on_their_segment"), F.sum("near").alias("neighbour_is_near"),
                       F.min("n").alias("least"), F.max("n").alias("most"))


# ---------------------------------------------------------------------------
# H5: the constrained grid
# ---------------------------------------------------------------------------
@register("constrained_grid", f"""
WITH {RANK_SQL},
v AS (SELECT count(*) FILTER (WHERE pos > floor(n * 0.5 + 0.5)) AS rows FROM k)
SELECT c AS "constraint", rows AS validated, 50 AS candidates, 1 AS chosen, true AS zero_first, true AS gap_not_above_baseline, true AS least_cost_chosen,
       true AS errors_are_counts FROM v, (VALUES ('demographic_parity'), ('equalized_odds')) AS t(c)
""")
def q_constrained_grid(spark, sf_dir):
    """H5: what must hold for any grid of 50 constrained models, for both constraints."""
    s = tb.scored_population(spark, sf_dir).select("application_id", "label", "lang", "source", "n_chars", "toxic")
    s = rank.stratified_split(s, "application_id", test_fraction=0.5).checkpoint()
    train, valid = s.filter("split = 'test'"), s.filter("split = 'train'")
    n = valid.count()
    out = []
    for constraint in (mit.DEMOGRAPHIC_PARITY, mit.EQUALIZED_ODDS):
        _, table = mit.constrained_grid(train, valid, "lang", mit.logistic_factory(["n_chars", "toxic"], ["source"], maxIter=5), constraint=constraint, threads=8)
        first = table.filter("candidate = 0").first()
        cost = F.col("error") + F.col("gap")
        whole = F.abs(F.col("error") * n - F.round(F.col("error") * n)) < 1e-6
        g0 = F.lit(first["gap"])
        out.append(table.agg(
            F.first("constraint").alias("constraint"), F.lit(n).cast("long").alias("validated"), F.count("*").cast("int").alias("candidates"), F.count_if("chosen").cast("int").alias("chosen"),
            F.lit(not any(first["multipliers"].values())).alias("zero_first"), F.min(~F.col("chosen") | (F.col("gap") <= g0)).alias("gap_not_above_baseline"),
            (F.min(F.when(F.col("gap") <= g0, cost)) == F.max(F.when(F.col("chosen"), cost))).alias("least_cost_chosen"), F.min(whole).alias("errors_are_counts")))
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------------------
# Sliding windows, and windows that the watermark has closed
# ---------------------------------------------------------------------------
@register("stream_sliding_stats", f"""
WITH {LOG_SQL},
w AS (SELECT lg.*, date_trunc('day', "timestamp") - to_days(CAST(k AS INTEGER)) AS window_start FROM lg, range(0, 3) AS t(k) WHERE "timestamp" IS NOT NULL)
SELECT window_start, window_start + INTERVAL 3 DAY AS window_end, count(*) AS predictions,
  {r("avg(CASE WHEN decision = 'approved' THEN 1.0 ELSE 0.0 END)", 'approval_rate')}, {r('avg(loan_amount)', 'avg_loan_amount')}
FROM w GROUP BY 1, 2
""")
def q_stream_sliding_stats(spark, sf_dir):
    """I2 over windows of three days that start every day."""
    path = sj.scratch_path(spark, "sliding")
    sj.run_counted(sj.windowed_stats(sj.log_stream(spark, sf_dir), "3 days", "1 day", "1 day"), path, "update")
    return round_doubles(sj.read_final(spark, path, keys=["window_start"]))


CLOSED_SQL = f"""{LOG_SQL},
c AS (SELECT lg.*, date_trunc('day', "timestamp") AS window_start FROM lg
      WHERE date_trunc('day', "timestamp") + INTERVAL 1 DAY <= (SELECT max("timestamp") - INTERVAL 1 DAY FROM lg))"""


@register("stream_closed_stats", f"""
WITH {CLOSED_SQL}
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS predictions,
  {r("avg(CASE WHEN decision = 'approved' THEN 1.0 ELSE 0.0 END)", 'approval_rate')}, {r('avg(loan_amount)', 'avg_loan_amount')}
FROM c GROUP BY 1, 2
""")
def q_stream_closed_stats(spark, sf_dir):
    """I2 in append mode: a window is written once, when it has closed."""
    path = sj.scratch_path(spark, "closed")
    sj.run_counted(sj.windowed_stats(sj.log_stream(spark, sf_dir)), path, "append")
    return round_doubles(sj.read_final(spark, path))


@register("stream_closed_gaps", f"""
WITH {CLOSED_SQL},
g AS (SELECT window_start, gender AS "group", count(*) AS n, count(*) FILTER (WHERE decision = 'approved') AS approved FROM c GROUP BY 1, 2),
o AS (SELECT *, CAST(approved AS DOUBLE) / n AS rate,
        CAST(sum(approved) OVER (PARTITION BY window_start) AS DOUBLE) / sum(n) OVER (PARTITION BY window_start) AS overall_rate FROM g)
SELECT window_start, "group", n, approved, {r('rate', 'rate')}, {r('overall_rate', 'overall_rate')},
  {r('max(abs(rate - overall_rate)) OVER (PARTITION BY window_start)', 'max_gap_to_overall')},
  {r('max(rate) OVER (PARTITION BY window_start) - min(rate) OVER (PARTITION BY window_start)', 'dp_difference')} FROM o
""")
def q_stream_closed_gaps(spark, sf_dir):
    """I3 inside foreachBatch: both parity gaps of every closed window."""
    path = sj.scratch_path(spark, "closed-gaps")
    sj.closed_group_gaps(sj.log_stream(spark, sf_dir), path)
    return round_doubles(sj.read_final(spark, path))


# ---------------------------------------------------------------------------
# Names of a long dictionary
# ---------------------------------------------------------------------------
@register("listed_names", """
WITH n AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[2:3], ' ') AS name FROM documents WHERE text IS NOT NULL),
l AS (SELECT name, length(name) AS priority FROM n WHERE name <> ''),
h AS (SELECT d.doc_id, l.name, l.priority FROM documents d JOIN l ON contains(lower(d.text), lower(l.name)))
SELECT doc_id, arg_min(name, (priority, name)) AS name FROM h GROUP BY doc_id
""")
def q_listed_names(spark, sf_dir):
    """C8 with a dictionary as long as the table: every document's second and third word make a name, shorter names first."""
    docs = tb.table(spark, sf_dir, "documents")
    two = F.array_join(F.slice(F.split("text", " ", 4), 2, 2), " ")  # the rest of the text stays in one piece
    names = docs.filter("text IS NOT NULL").select(two.alias("name")).distinct().withColumn("priority", F.length("name").cast("long"))
    return dc.listed_names(docs, names)
