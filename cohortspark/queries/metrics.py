"""Splits, folds, scaling and metrics over the given tables.

For metrics, ``labels.quality`` is the truth and the length of the document the score.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators import evaluation, records, splits
from cohortspark.plans.models import fold_moments, other_folds_scale
from cohortspark.plans.models import scale_unit_std as scale
from cohortspark.queries.events import INDEX_CTE, sweep_frame, wide_cte
from cohortspark.queries.registry import query, table
from cohortspark.sources import durable
from cohortspark.sources import report_metrics as report

THRESHOLD = 1000


def scored_frame(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents.join(labels, "doc_id").withColumn(
        "prediction", (F.col("score") > THRESHOLD).cast("double")
    )


def counts_frame(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.threshold_counts(scored_frame(spark, folder))


SCORED_CTE = f"""
WITH s AS (SELECT doc_id, n_chars::DOUBLE AS score, quality AS label, CASE WHEN n_chars > {THRESHOLD} THEN 1 ELSE 0 END AS prediction
           FROM documents JOIN labels USING (doc_id))"""

COUNTS_CTE = f"""{SCORED_CTE},
 g AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY 1),
 c AS (SELECT threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
              sum(pos) OVER () AS p, sum(neg) OVER () AS n
       FROM g WINDOW w AS (ORDER BY threshold DESC))"""


# --- splits and folds --------------------------------------------------------------------------------------------

SCALED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


ORACLE_SCALE = (
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(f"round({c} / (SELECT stddev_samp({c}) FROM lineitem), 6) AS {c}" for c in SCALED)
    + " FROM lineitem"
)


@query(ORACLE_SCALE)
def scale_unit_std(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *SCALED)
    (scaled,) = scale(VectorAssembler(inputCols=list(SCALED), outputCol="features").transform(lines))
    values = vector_to_array("scaled")
    return scaled.select(
        "l_orderkey", "l_linenumber", "l_partkey", *[F.round(values[i], 6).alias(c) for i, c in enumerate(SCALED)]
    )


@query(ORACLE_SCALE)
def scale_columns(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *SCALED)
    scaled = records.scale_columns(lines, SCALED)
    return scaled.withColumns({c: F.round(c, 6) for c in SCALED})


OFFSET = 100_000


@query(
    f"""
SELECT fold, column_name, round(spread, 6) AS spread FROM (
  SELECT f.fold, {', '.join(f'stddev_samp({c} + {OFFSET}) AS {c}' for c in SCALED)}
  FROM lineitem, (VALUES (0), (1), (2), (3), (4)) AS f(fold) WHERE l_orderkey % 5 <> f.fold GROUP BY 1)
UNPIVOT (spread FOR column_name IN ({', '.join(SCALED)}))
"""
)
def fold_scales(spark: SparkSession, folder: str) -> DataFrame:
    """Deviation of the train rows of each fold, for columns far from zero; all folds from one aggregation."""
    lines = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), *[(F.col(c) + OFFSET).alias(c) for c in SCALED])
    moments = fold_moments(VectorAssembler(inputCols=list(SCALED), outputCol="features").transform(lines), ["fold"])
    rows = [(fold, c, 1 / float(x)) for fold in range(5) for c, x in zip(SCALED, other_folds_scale(moments, (), fold))]
    return spark.createDataFrame(rows, "fold INT, column_name STRING, spread DOUBLE").withColumn("spread", F.round("spread", 6))


@query(
    """
SELECT o_orderkey,
  CAST(('0x' || substr(md5('11:' || o_orderkey::VARCHAR), 1, 8))::BIGINT < floor(0.67 * 4294967296)::BIGINT AS INT) AS is_train
FROM orders
"""
)
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_split(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INT) AS fold FROM orders")
def kfold_assign(spark: SparkSession, folder: str) -> DataFrame:
    return splits.kfold_assign(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query(
    """
SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY md5('545510477:' || o_orderkey::VARCHAR), o_orderkey) - 1) % 5 AS INT) AS fold
FROM orders
"""
)
def stratified_kfold_assign(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return splits.stratified_kfold_assign(orders, "o_orderkey", "o_orderstatus")


@query(
    """
SELECT o_orderkey, CAST(('0x' || substr(md5('11' || coalesce(':' || nullif(o_orderstatus, 'F') || o_custkey, ' NULL')), 1, 8))::BIGINT
  < floor(0.67 * 4294967296)::BIGINT AS INT) AS is_train
FROM orders
"""
)
def hash_split_missing_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A text key that many rows lack: these rows share a side instead of being lost."""
    key = F.concat(F.nullif("o_orderstatus", F.lit("F")), F.col("o_custkey").cast("string"))
    orders = table(spark, folder, "orders").select("o_orderkey", key.alias("k"))
    return splits.assign_split(orders, "k").select("o_orderkey", "is_train")


@query("SELECT k, CAST(ntile(5) OVER (ORDER BY k) - 1 AS INT) AS fold FROM (SELECT 'key ' || o_orderkey AS k FROM orders)")
def kfold_assign_text(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "orders").select(F.concat(F.lit("key "), F.col("o_orderkey").cast("string")).alias("k"))
    return splits.kfold_assign(keys, "k")


@query(
    """
SELECT o_orderpriority, fold, count(*) AS n_rows
FROM (SELECT o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority) - 1) % 5 AS INT) AS fold FROM orders)
GROUP BY 1, 2
"""
)
def stratified_folds_missing_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a key stay, and folds of a stratum differ by one row at most."""
    key = F.nullif(F.col("o_orderkey") % 50, F.lit(0))
    orders = table(spark, folder, "orders").select("o_orderpriority", key.alias("k"))
    return splits.fold_sizes(splits.stratified_kfold_assign(orders, "k", "o_orderpriority"), ["o_orderpriority", "fold"])


# --- metrics -----------------------------------------------------------------------------------------------------


@query(
    f"""{SCORED_CTE},
 m AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
   count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM s)
SELECT round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1
FROM m
"""
)
def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    metrics = evaluation.binary_metrics(scored_frame(spark, folder))
    return metrics.select(*[F.round(c, 9).alias(c) for c in metrics.columns])


@query(
    f"""{SCORED_CTE},
 k AS (SELECT cls, count(*) FILTER (label = cls) AS actual, count(*) FILTER (prediction = cls) AS guessed,
       count(*) FILTER (label = cls AND prediction = cls) AS hit FROM s, (VALUES (0), (1)) v(cls) GROUP BY 1)
SELECT round(sum(hit) / sum(actual), 6) AS accuracy,
  round(sum(actual * coalesce(2 * hit / nullif(actual + guessed, 0), 0)) / sum(actual), 6) AS f1,
  round(sum(actual * coalesce(hit / nullif(guessed, 0), 0)) / sum(actual), 6) AS weighted_precision,
  round(sum(actual * coalesce(hit / nullif(actual, 0), 0)) / sum(actual), 6) AS weighted_recall
FROM k
"""
)
def weighted_metrics(spark: SparkSession, folder: str) -> DataFrame:
    metrics = evaluation.weighted_metrics(scored_frame(spark, folder))
    return metrics.select(*[F.round(c, 6).alias(c) for c in metrics.columns])


@query(
    f"""{COUNTS_CTE} SELECT threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM c
UNION ALL SELECT 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE"""
)
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    points = evaluation.roc_points(counts_frame(spark, folder))
    return points.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(
    f"""{COUNTS_CTE} SELECT threshold, round(tp / p, 9) AS recall, round(tp / (tp + fp), 9) AS precision FROM c
UNION ALL SELECT 'infinity'::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE"""
)
def pr_points(spark: SparkSession, folder: str) -> DataFrame:
    points = evaluation.pr_points(counts_frame(spark, folder))
    return points.select("threshold", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


ROC_AREA = "sum(neg::DOUBLE * (2 * tp - pos) / 2) / (max(p)::DOUBLE * max(n))"
PR_AREA = """sum(pos * (tp / (tp + fp) + CASE WHEN tp + fp = pos + neg THEN tp / (tp + fp)
 ELSE (tp - pos) / (tp - pos + fp - neg) END) / 2) / max(p)"""


@query(f"{COUNTS_CTE} SELECT round({ROC_AREA}, 6) AS auroc FROM c")
def auroc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.auroc(counts_frame(spark, folder)).select(F.round("auroc", 6).alias("auroc"))


@query(f"{COUNTS_CTE} SELECT round({PR_AREA}, 6) AS auprc FROM c")
def auprc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.auprc(counts_frame(spark, folder)).select(F.round("auprc", 6).alias("auprc"))


@query(
    f"""{COUNTS_CTE}, f AS (SELECT threshold, 2 * tp / (tp + fp + p) AS f_measure FROM c)
SELECT threshold, round(f_measure, 9) AS f_measure FROM f ORDER BY f.f_measure DESC, threshold DESC LIMIT 1
"""
)
def best_f_threshold(spark: SparkSession, folder: str) -> DataFrame:
    best = evaluation.best_f_threshold(counts_frame(spark, folder))
    return best.select("threshold", F.round("f_measure", 9).alias("f_measure"))


BY_WINDOW_SQL = f"""
{INDEX_CTE}, {wide_cte('latest', swept=True)},
 g AS (SELECT pred_hours, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
       FROM wide GROUP BY 1, 2),
 c AS (SELECT pred_hours, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
              sum(pos) OVER (PARTITION BY pred_hours) AS p, sum(neg) OVER (PARTITION BY pred_hours) AS n
       FROM g WINDOW w AS (PARTITION BY pred_hours ORDER BY score DESC)),
 areas AS (SELECT pred_hours, coalesce({ROC_AREA}, 0) AS auroc, coalesce({PR_AREA}, 0) AS auprc FROM c GROUP BY 1),
 m AS (SELECT pred_hours, count(*) FILTER (label = 1 AND score >= 2) AS tp, count(*) FILTER (label = 0 AND score >= 2) AS fp,
   count(*) FILTER (label = 1 AND score < 2) AS fn, count(*) FILTER (label = 0 AND score < 2) AS tn FROM wide GROUP BY 1),
 hard AS (SELECT pred_hours, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
   coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM m),
 rows AS (UNPIVOT (SELECT pred_hours, accuracy, precision, recall, f1, auroc, auprc FROM hard JOIN areas USING (pred_hours))
          ON accuracy, precision, recall, f1, auroc, auprc INTO NAME metric VALUE value)
SELECT 'score rule' AS model, pred_hours, metric, round(value, 6) AS value FROM rows
"""


def window_metrics(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Metrics of the rule-based score as a classifier, per prediction window."""
    swept = durable(sweep_frame(spark, folder)).withColumn("prediction", (F.col("score") >= 2).cast("double"))
    by = ["pred_hours"]
    counts = evaluation.threshold_counts(swept, by=by)
    hard = evaluation.metric_rows(evaluation.binary_metrics(swept, by=by), ["accuracy", "precision", "recall", "f1"], by)
    areas = evaluation.metric_rows(evaluation.area_metrics(counts, by), ["auroc", "auprc"], by)
    return [
        rows.select(F.lit("score rule").alias("model"), *by, "metric", F.round("value", 6).alias("value"))
        for rows in (hard, areas)
    ]


@query(BY_WINDOW_SQL)
def metrics_by_window(spark: SparkSession, folder: str) -> DataFrame:
    return report(window_metrics(spark, folder))
