"""Model searches, fits and reports.

What a search finds on arbitrary features cannot be written as SQL. Most queries here fit on features of which one column tells
nearly everything: the balance of a customer is to be told from a mark that is wrong for every seventh customer, among
columns that tell nothing. Every classifier that has learned anything then ranks and predicts by the mark, and all metrics
follow from counts of marks and labels; one that has not, or that looks at wrong rows, gives other metrics. Unpenalised
regressions on the mark have closed forms for their coefficients as well.

The searches for a logistic regression and for a forest run on the feature set of the events too, with the same whole grids.
SQL holds the rows of each label that their best models are tested on, and that all six metrics of these are shares.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.columns import apply_threshold, vector_element
from cohortspark.operators.features import assemble_vectors
from cohortspark.plans import models
from cohortspark.plans.feature_sets import feature_vectors
from cohortspark.queries.events import INDEX_CTE, SPEC, feature_frame, wide_cte
from cohortspark.queries.metrics import SCORED_CTE, scored_frame
from cohortspark.queries.registry import query, table
from cohortspark.sources import report_metrics as report, shared_folder

KEY = "c_custkey"
PARALLEL = 8
ZERO_ONE_FIT = {"maxIter": 200, "regParam": 0.0, "tol": 1e-12, "standardization": False, "predictionCol": "guess"}

#: Columns of the feature set, and the one with the mark.
WIDTH, MARKED = 12, 5

#: Prediction windows; the mark of each is wrong for other customers.
WINDOWS = (1, 2, 4)

LABEL = "c_acctbal > 4500"


def mark(spark: SparkSession, folder: str, every: Column) -> DataFrame:
    """(c_custkey, label, x): ``x`` is the label, but for one in so many customers the other one."""
    label = F.expr(LABEL)
    wrong = F.col(KEY) % every == 3
    return table(spark, folder, "customer").select(
        KEY, label.cast("int").alias("label"), F.when(wrong, ~label).otherwise(label).cast("double").alias("x")
    )


def assembled(marked: DataFrame, *keep: str) -> DataFrame:
    """Feature vectors with the mark in one column and zeros in all others."""
    columns = [f"f{i}" for i in range(WIDTH)]
    wide = marked.select(KEY, *keep, "label", *[F.col("x").alias(c) if i == MARKED else F.lit(0.0).alias(c) for i, c in enumerate(columns)])
    return assemble_vectors(wide, columns, label="label", keep=[KEY, *keep])


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return models.compact(assembled(mark(spark, folder, F.lit(7))))


def swept_vectors(spark: SparkSession, folder: str) -> DataFrame:
    swept = [mark(spark, folder, F.lit(5 + h)).withColumn("pred_hours", F.lit(h)) for h in WINDOWS]
    return models.compact(assembled(reduce(DataFrame.unionByName, swept), "pred_hours"))


def event_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The feature set of the events: scores, latest values and static attributes before the index times."""
    return models.compact(feature_vectors(feature_frame(spark, folder), SPEC))


def rounded(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("value", F.round("value", 6))


def marked_cte(windows: bool = False) -> str:
    every, more, hours = ("5 + pred_hours", ", pred_hours", f", (VALUES {', '.join(f'({h})' for h in WINDOWS)}) AS h(pred_hours)") if windows else ("7", "", "")
    return f"""
WITH mk AS (SELECT c_custkey{more}, CAST({LABEL} AS INT) AS label,
            CAST(({LABEL}) <> (c_custkey % ({every}) = 3) AS INT) AS x FROM customer{hours})"""


def held_out(share: float, seed: int, key: str = KEY) -> str:
    return f"""('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 8))::BIGINT >= floor({share} * 4294967296)::BIGINT"""


#: Metrics of predictions that equal the mark, from the numbers tp, fp, fn and tn.
AREA = "CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN (1 + tp / (tp + fn) - fp / (fp + tn)) / 2 ELSE 0 END"
MARK_METRICS = {
    "accuracy": "(tp + tn) / (tp + fp + fn + tn)",
    "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
    "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
    "auroc": AREA,
}
WEIGHTED_METRICS = {
    "accuracy": "(tp + tn) / (tp + fp + fn + tn)",
    "f1": """((tp + fn) * coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + (fp + tn) * coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0))
      / (tp + fp + fn + tn)""",
    "weighted_precision": """((tp + fn) * coalesce(tp / nullif(tp + fp, 0), 0) + (fp + tn) * coalesce(tn / nullif(tn + fn, 0), 0))
      / (tp + fp + fn + tn)""",
    "weighted_recall": "(tp + tn) / (tp + fp + fn + tn)",
    "auroc": AREA,
    "auprc": """tp / (tp + fn) * coalesce(tp / nullif(tp + fp, 0), 0)
      + fn / (tp + fn) * (coalesce(tp / nullif(tp + fp, 0), 0) + (tp + fn) / (tp + fp + fn + tn)) / 2""",
}


def counted_cte(rows: str, by: str = "") -> str:
    """Numbers of marks and labels of some rows, named ``m``."""
    groups = f" GROUP BY {by}" if by else ""
    named = f"{by}, " if by else ""
    return f""" m AS (SELECT {named}count(*) FILTER (label = 1 AND x = 1)::DOUBLE AS tp, count(*) FILTER (label = 0 AND x = 1)::DOUBLE AS fp,
   count(*) FILTER (label = 1 AND x = 0)::DOUBLE AS fn, count(*) FILTER (label = 0 AND x = 0)::DOUBLE AS tn FROM {rows}{groups})"""


def metric_sql(model: str, metrics: dict[str, str], keep: str = "") -> str:
    """A row for each metric of each row of ``m``."""
    kept = f", {keep}" if keep else ""
    return "\nUNION ALL ".join(f"SELECT '{model}' AS model{kept}, '{name}' AS metric, {value} AS value FROM m" for name, value in metrics.items())


def search_sql(*names: str) -> str:
    test = f"(SELECT * FROM mk WHERE {held_out(0.67, 11)})"
    rows = "\nUNION ALL ".join(metric_sql(name, WEIGHTED_METRICS) for name in names)
    return f"{marked_cte()}, {counted_cte(test)}\nSELECT model, metric, round(value, 6) AS value FROM ({rows})"


def both_searches_sql(name: str) -> str:
    """A search on the features of the events, and one on the mark."""
    return f"""
SELECT 'events' AS features, model, metric, value FROM ({INDEX_CTE}, {wide_cte('latest')},
 te AS (SELECT label FROM wide WHERE {held_out(0.67, 11, SPEC.entity)})
 SELECT '{name}' AS model, 'tested_' || label AS metric, count(*)::DOUBLE AS value FROM te GROUP BY label
 UNION ALL SELECT '{name}', 'metrics_that_are_shares', 6.0::DOUBLE)
UNION ALL SELECT 'marked', model, metric, value FROM ({search_sql(name)})"""


def both_searches(on_events: models.Fitted, on_marks: models.Fitted) -> DataFrame:
    by_label = F.concat(F.lit("tested_"), F.col("label").cast("int")).alias("metric")
    tested = on_events.predictions.groupBy("model", by_label).agg(F.count(F.lit(1)).cast("double").alias("value"))
    share = F.when(F.col("value").between(0, 1), F.col("metric"))
    shares = on_events.metrics.groupBy("model", F.lit("metrics_that_are_shares").alias("metric")).agg(
        F.count_distinct(share).cast("double").alias("value")
    )
    parts = {"events": tested.unionByName(shares), "marked": rounded(on_marks.metrics)}
    return reduce(DataFrame.unionByName, [part.withColumn("features", F.lit(name)) for name, part in parts.items()])


@query(both_searches_sql("LogisticRegression"))
def logistic_cv(spark: SparkSession, folder: str) -> DataFrame:
    on_events = models.fit_logistic_cv(event_vectors(spark, folder), SPEC.entity, parallelism=PARALLEL)
    return both_searches(on_events, models.fit_logistic_cv(vectors(spark, folder), KEY, parallelism=PARALLEL))


@query(both_searches_sql("RandomForest"))
def forest_cv(spark: SparkSession, folder: str) -> DataFrame:
    on_events = models.fit_forest_cv(event_vectors(spark, folder), SPEC.entity, parallelism=PARALLEL)
    return both_searches(on_events, models.fit_forest_cv(vectors(spark, folder), KEY, parallelism=PARALLEL))


@query(search_sql("GradientBoostedTrees"))
def gbt_cv(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.fit_gbt_cv(vectors(spark, folder), KEY, parallelism=PARALLEL).metrics)


@query(search_sql("MultiLayerPerceptron"))
def mlp_cv(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.fit_mlp_cv(vectors(spark, folder), KEY, parallelism=PARALLEL, width=WIDTH).metrics)


@query(
    f"""{SCORED_CTE},
 o AS (SELECT prediction AS x, count(*) FILTER (label = 1) AS yes, count(*) FILTER (label = 0) AS no FROM s GROUP BY 1)
SELECT round(ln(yes / no), 4) AS log_odds, x FROM o WHERE yes > 0 AND no > 0
"""
)
def logistic_closed_form(spark: SparkSession, folder: str) -> DataFrame:
    """An unpenalised fit on one column of zeros and ones: intercept and coefficient are log-odds."""
    scored = scored_frame(spark, folder).select("prediction", F.col("label").cast("double").alias("label"))
    rows = models.compact(VectorAssembler(inputCols=["prediction"], outputCol="features").transform(scored))
    model = LogisticRegression(**ZERO_ONE_FIT).fit(rows)
    at_zero, at_one = model.intercept, model.intercept + model.coefficients[0]
    found = rows.select(F.col("prediction").cast("int").alias("x")).distinct()
    return found.select(F.round(F.when(F.col("x") == 1, at_one).otherwise(at_zero), 4).alias("log_odds"), "x")


@query(
    f"""{SCORED_CTE},
 o AS (SELECT prediction AS x, avg(label) AS p FROM s GROUP BY 1)
SELECT doc_id, round(p, 4) AS probability, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS above FROM s JOIN o ON x = prediction
"""
)
def predicted_probability(spark: SparkSession, folder: str) -> DataFrame:
    """One element of the vector of probabilities of that fit, and whether it is above a half."""
    scored = scored_frame(spark, folder).select("doc_id", "prediction", F.col("label").cast("double").alias("label"))
    rows = models.compact(VectorAssembler(inputCols=["prediction"], outputCol="features").transform(scored))
    fitted = LogisticRegression(**ZERO_ONE_FIT).fit(rows)
    chance = vector_element("probability", 1)
    return fitted.transform(rows).select("doc_id", F.round(chance, 4).alias("probability"), apply_threshold(chance, 0.5).alias("above"))


#: Without a penalty; the mark is scaled by its deviation, so coefficients are log-odds times that.
UNPENALISED = {
    "binomial": {"maxIter": 200, "regParam": 0.0, "tol": 1e-12},
    "multinomial": {"maxIter": 200, "regParam": 0.0, "tol": 1e-12, "family": "multinomial"},
}

PLAIN_CTE = f"""{marked_cte()},
 s AS (SELECT x, avg(label) AS p, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM mk GROUP BY 1),
 f AS (SELECT (SELECT p FROM s WHERE x = 1) AS p1, (SELECT p FROM s WHERE x = 0) AS p0, (SELECT stddev_samp(x) FROM mk) AS d),
 o AS (SELECT ln(p0 / (1 - p0)) AS b, (ln(p1 / (1 - p1)) - ln(p0 / (1 - p0))) * d AS c, p0, p1 FROM f),
{counted_cte('mk')}"""

BEST_THRESHOLD = "CASE WHEN 2 * tp / (2 * tp + fp + fn) >= 2 * (tp + fn) / (2 * (tp + fn) + fp + tn) THEN p1 ELSE p0 END"


def plain_sql() -> str:
    rows = [f"SELECT 'binomial' AS model, 'coefficient_0_{i}' AS metric, {'c' if i == MARKED else '0'} AS value FROM o" for i in range(WIDTH)]
    rows += ["SELECT 'binomial', 'intercept_0', b FROM o"]
    for k, sign in enumerate("-+"):  # both classes share the odds
        rows += [f"SELECT 'multinomial', 'coefficient_{k}_{i}', {f'{sign}c / 2' if i == MARKED else '0'} FROM o" for i in range(WIDTH)]
        rows += [f"SELECT 'multinomial', 'intercept_{k}', {sign}b / 2 FROM o"]
    for model in UNPENALISED:
        rows += [f"SELECT '{model}', 'auroc', {AREA} FROM m", f"SELECT '{model}', 'threshold', {BEST_THRESHOLD} FROM m, o"]
    return f"{PLAIN_CTE}\nSELECT model, metric, round(value, 3) + 0.0 AS value FROM ({' UNION ALL '.join(rows)})"


@query(plain_sql())
def logistic_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients, intercepts, areas and best thresholds of both unpenalised regressions."""
    fitted = models.fit_logistic_plain(vectors(spark, folder), UNPENALISED)
    reported = report([models.logistic_summary(model, name) for name, model in fitted.items()])
    return reported.withColumn("value", F.round("value", 3) + F.lit(0.0))


@query(
    f"""{PLAIN_CTE}
SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT round(fp / (fp + tn), 9), round(tp / (tp + fn), 9) FROM m UNION ALL SELECT 1, 1
"""
)
def logistic_summary(spark: SparkSession, folder: str) -> DataFrame:
    points = models.summary_roc(models.fit_logistic_plain(vectors(spark, folder))["binomial"])
    return points.select(F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(f"{marked_cte()}, {counted_cte(f'(SELECT * FROM mk WHERE {held_out(0.75, 0)})')}\nSELECT model, metric, round(value, 6) AS value FROM ({metric_sql('RandomForest', MARK_METRICS)})")
def forest_plain(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.forest_report(vectors(spark, folder), KEY))


KFOLD = "CAST(ntile(5) OVER (PARTITION BY {by} ORDER BY c_custkey) - 1 AS INT)"
STRATIFIED = """CAST((row_number() OVER (PARTITION BY {by}, label
  ORDER BY md5('545510477:' || c_custkey::VARCHAR), c_custkey) - 1) % 5 AS INT)"""


def fold_sql(*kinds: tuple[str, str], windows: bool = False) -> str:
    """Mean metrics over folds, per window."""
    kept = ", pred_hours" if windows else ""
    by = "pred_hours" if windows else "1"
    parts = []
    for name, fold in kinds:
        folded = f"(SELECT *, {fold.format(by=by)} AS fold FROM mk)"
        rows = metric_sql(name, MARK_METRICS, by.replace("1", "")) if windows else metric_sql(name, MARK_METRICS)
        counted = counted_cte(folded, f"fold{kept}")
        parts.append(f"SELECT * FROM (WITH {counted} SELECT model{kept}, metric, round(sum(value) / 5, 6) AS value FROM ({rows}) GROUP BY ALL)")
    return f"{marked_cte(windows)}\n" + "\nUNION ALL ".join(parts)


@query(fold_sql(("RandomForest/kfold", KFOLD)))
def kfold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.kfold_metrics(vectors(spark, folder), KEY))


@query(fold_sql(("RandomForest/stratified", STRATIFIED)))
def stratified_kfold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.stratified_kfold_metrics(vectors(spark, folder), KEY))


@query(
    f"{marked_cte(True)}, {counted_cte(f'(SELECT * FROM mk WHERE {held_out(0.75, 0)})', 'pred_hours')}\n"
    f"SELECT model, pred_hours, metric, round(value, 6) AS value FROM ({metric_sql('RandomForest', MARK_METRICS, 'pred_hours')})"
)
def forest_by_window(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.metrics_by_window(swept_vectors(spark, folder), KEY))


@query(fold_sql(("RandomForest/kfold", KFOLD), ("RandomForest/stratified", STRATIFIED), windows=True))
def fold_metrics_by_window(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.fold_metrics_by_window(swept_vectors(spark, folder), KEY))


MODEL_NAMES = ("LogisticRegression", "GradientBoostedTrees", "MultiLayerPerceptron", "RandomForest")


@query(search_sql(*MODEL_NAMES))
def compare_models(spark: SparkSession, folder: str) -> DataFrame:
    compared = models.compare_models(vectors(spark, folder), KEY, parallelism=PARALLEL, width=WIDTH)
    return rounded(report([compared], shared_folder(spark)))
