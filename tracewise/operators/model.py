"""Recycle-or-dispose classifier with Spark ML (M3-M8).

The reference fits scikit-learn's default logistic regression (L2, C=1,
unpenalised intercept) on standardised features. Its objective
``½‖w‖² + C·Σ logloss`` divided by ``n·C`` is Spark's ``mean logloss +
(regParam/2)‖w‖²`` with ``regParam = 1/(n·C)``; features are already scaled,
so Spark's own standardisation is off.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def split(df: DataFrame, test_fraction: float = 0.3, seed: int = 42,
          key: str = "InstanceID") -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: the same rows on every run, every
    cluster size and every engine that has MD5 (M3). The reference's random rows cannot be reproduced."""
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    bucket = F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long")
    limit = F.lit(round(test_fraction * (1 << 24)))
    return df.filter(bucket >= limit), df.filter(bucket < limit)


def fit_logistic(train: DataFrame, features: list[str], label: str = "target",
                 c: float = 1.0, max_iter: int = 100) -> PipelineModel:
    """L2 logistic regression equal to C-regularised scikit-learn (M4).

    Refuses single-class input (Spark would return an infinite intercept).
    """
    stats = train.agg(F.count(F.lit(1)).alias("n"),
                      F.count_distinct(F.col(label)).alias("k")).first()
    if stats["n"] == 0:
        raise ValueError("no training rows")
    if stats["k"] < 2:
        raise ValueError("training data has a single class")
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label",
                            regParam=1.0 / (stats["n"] * c), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, maxIter=max_iter,
                            tol=1e-9)
    data = train.withColumn("label", F.col(label).cast("double"))
    return Pipeline(stages=[assembler, lr]).fit(data)


def coefficients(model: PipelineModel) -> tuple[list[float], float]:
    """(weights, intercept) of a fitted model."""
    lr = model.stages[-1]
    return [float(x) for x in lr.coefficients], float(lr.intercept)


def _probability(features: list[str], weights: list[float], intercept: float):
    z = F.lit(float(intercept))
    for f, w in zip(features, weights):
        z = z + F.col(f) * F.lit(float(w))
    return 1.0 / (1.0 + F.exp(-z))


def gradient(train: DataFrame, features: list[str], weights: list[float], intercept: float,
             label: str = "target", c: float = 1.0) -> DataFrame:
    """(term, gradient, n_rows): the slope of the fitted objective (mean log loss plus the L2 term) along each
    weight and the intercept, from one aggregate over the rows; all 0 at the optimum (M4)."""
    error = _probability(features, weights, intercept) - F.col(label)
    sums = train.agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("intercept"),
                     *[F.avg(error * F.col(f)).alias(f"g_{f}") for f in features])
    terms = [F.struct(F.lit("intercept").alias("term"), F.col("intercept").alias("gradient"))] + [
        F.struct(F.lit(f).alias("term"), (F.col(f"g_{f}") + F.lit(float(w)) / (F.col("n") * c)).alias("gradient"))
        for f, w in zip(features, weights)]
    return sums.select(F.explode(F.array(*terms)).alias("t"), "n").select("t.term", "t.gradient", F.col("n").alias("n_rows"))


def predict_given(df: DataFrame, features: list[str], weights: list[float], intercept: float) -> DataFrame:
    """Adds ``p_recycle`` and ``prediction`` (0/1 int) from given coefficients, in the JVM's own expressions (M5)."""
    return df.withColumn("p_recycle", _probability(features, weights, intercept)) \
        .withColumn("prediction", (F.col("p_recycle") > 0.5).cast("int"))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` (0/1 int) and ``p_recycle`` (M5)."""
    out = model.transform(df)
    return out.withColumn("p_recycle", vector_to_array("probability")[1]) \
        .withColumn("prediction", F.col("prediction").cast("int")) \
        .drop("features", "rawPrediction", "probability")


def accuracy(pred: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    """Share of correct predictions, one row (M6)."""
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def classification_report(pred: DataFrame, label: str = "target",
                          prediction: str = "prediction", digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and
    support-weighted averages; a zero division gives 0 (M7).

    Works from the confusion counts (one row per (label, prediction) pair),
    so only a handful of rows leave the first aggregation.
    """
    conf = pred.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")) \
        .agg(F.count(F.lit(1)).alias("n"))
    roles = conf.select(F.explode(F.array(
        F.struct(F.col("t").alias("cls"), F.col("n").alias("support"),
                 F.lit(0).alias("predicted"), F.when(F.col("t") == F.col("p"), F.col("n"))
                 .otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("cls"), F.lit(0).alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).alias("tp")))).alias("r"))
    per = roles.groupBy(F.col("r.cls").alias("cls")).agg(
        F.sum("r.support").alias("support"), F.sum("r.predicted").alias("predicted"),
        F.sum("r.tp").alias("tp"))
    z = F.lit(0.0)
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), z)
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), z)
    per = per.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1_score", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                            F.col("precision") + F.col("recall")), z))
    total = F.sum("support")
    summary = per.agg(
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"),
        F.avg("f1_score").alias("m_f"),
        F.try_divide(F.sum(F.col("precision") * F.col("support")), total).alias("w_p"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), total).alias("w_r"),
        F.try_divide(F.sum(F.col("f1_score") * F.col("support")), total).alias("w_f"),
        F.try_divide(F.sum("tp").cast("double"), total).alias("acc"),
        total.alias("n"))
    r = lambda c: F.round(c, digits)
    classes = per.select(F.col("cls").cast("string").alias("label"), r(F.col("precision"))
                         .alias("precision"), r(F.col("recall")).alias("recall"),
                         r(F.col("f1_score")).alias("f1_score"),
                         F.col("support").cast("bigint").alias("support"))
    def row(label, p, rc, f1):
        return F.struct(F.lit(label).alias("label"), p.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f1.alias("f1_score"),
                        F.col("n").cast("bigint").alias("support"))

    none = F.lit(None)
    rows = summary.select(F.explode(F.array(
        row("accuracy", none, none, r(F.col("acc"))),
        row("macro avg", r(F.col("m_p")), r(F.col("m_r")), r(F.col("m_f"))),
        row("weighted avg", r(F.col("w_p")), r(F.col("w_r")), r(F.col("w_f"))))).alias("x")
    ).select("x.*")
    return classes.unionByName(rows)


def save(model: PipelineModel, path: str | None = None, spark=None) -> str:
    """Write the fitted pipeline (assembler + model) to ``path``, by default
    below the shared checkpoint folder (M8, S9)."""
    if path is None:
        path = scratch_path(spark, "recycle-model")
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
