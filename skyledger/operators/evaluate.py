"""Exact metrics of probabilities, folds by years, samples, and models on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.functions.columns import hash_bucket, ratio
from skyledger.operators import boost
from skyledger.sources.raw import materialised


SCORE_BINS = 1024


def binary_metrics(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """``n, base_rate, auc, pr_auc, brier``, exact, ties included; areas are null with one class.
    Rows are first added up by distinct score."""
    keys = by or []
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    y = F.col(label).cast("double")
    return metrics_of_counts(rows.groupBy(*keys, F.col(score).cast("double").alias("p")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")), keys)


def metrics_of_counts(steps: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics of ``steps``: for each score ``p``, once by ``keys``, how many of either class have it.

    Scores fall into ``SCORE_BINS`` bins of equal width. A window runs down the few bins, and others
    down the scores of one bin each, so no task sees all scores.
    """
    clipped = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0))
    steps = steps.withColumns({"err": F.col("pos") * (1 - clipped) * (1 - clipped) + F.col("neg") * clipped * clipped, "_bin": F.floor(clipped * SCORE_BINS).cast("int")})
    above = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = steps.groupBy(*keys, "_bin").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    bins = bins.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"), *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"{c}_above") for c in ("_pos", "_neg")])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    down = Window.partitionBy(*keys, "_bin").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.join(bins, reduce(lambda a, b: a & b, same, F.col("_bin") == F.col("_b")))
    run = run.withColumns({"tp": F.sum("pos").over(down) + F.col("_pos_above"), "fp": F.sum("neg").over(down) + F.col("_neg_above")})
    total_p, total_n = F.sum("pos"), F.sum("neg")
    # a positive beats the negatives below it and half of those that tie; what was above is fp
    won = F.sum(F.col("pos") * (-F.col("fp") + F.col("neg") / 2))
    both = (total_p > 0) & (total_n > 0)
    return run.groupBy(*keys).agg(
        (total_p + total_n).cast("long").alias("n"),
        ratio(total_p, total_p + total_n).alias("base_rate"),
        F.when(both, (won + total_p * total_n) / (total_p * total_n)).alias("auc"),
        F.when(both, F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / total_p).alias("pr_auc"),
        ratio(F.sum("err"), total_p + total_n).alias("brier"),
    )


def calibration_table(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Observed rate and mean probability of equal-width bins."""
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0))
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin"), p.alias("p"), F.col(label).cast("double").alias("y"))
    out = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def naive_baselines(df: DataFrame, columns: dict[str, str], fallback: float | Column) -> DataFrame:
    """``df`` with a probability of each baseline: a lagged rate, or the training rate without one."""
    fill = F.lit(fallback) if isinstance(fallback, (int, float)) else fallback
    return df.withColumns({name: F.least(F.greatest(F.coalesce(F.col(c).cast("double"), fill), F.lit(0.0)), F.lit(1.0)) for name, c in columns.items()})


@dataclass(frozen=True)
class Fold:
    name: str
    train: tuple[int, ...]
    valid: int
    test: tuple[int, ...]

    def check(self) -> Fold:
        if not self.train or not max(self.train) < self.valid < min(self.test):
            raise ValueError(f"{self.name}: years overlap or are out of order")
        return self

    def part(self, df: DataFrame, which: str) -> DataFrame:
        years = {"train": self.train, "valid": (self.valid,), "test": self.test}[which]
        return df.where(F.col("year").isin(*years))


def rolling_origin(test_years: tuple[int, ...], first: int) -> list[Fold]:
    """For each test year: train up to two years before, validate on the year before."""
    return [Fold(f"rolling_{y}", tuple(range(first, y - 1)), y - 1, (y,)).check() for y in test_years]


def fixed_split(train: tuple[int, ...], valid: int, test: tuple[int, ...]) -> Fold:
    return Fold("fixed", train, valid, test).check()


def route_sample(df: DataFrame, rate: float, key: str = "route") -> DataFrame:
    """Whole routes of about ``rate`` of the buckets, the same in every year."""
    if rate <= 0:
        raise ValueError("the rate must be positive")
    return df if rate >= 1 else df.where(hash_bucket(key) < round(rate * 1000))


def stride_sample(df: DataFrame, strata: list[str], order: list[str], per_stratum: int) -> DataFrame:
    """Every k-th row of each stratum in order, k such that about ``per_stratum`` are taken."""
    w = Window.partitionBy(*strata)
    rows = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_k": F.row_number().over(w.orderBy(*order)) - 1})
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / per_stratum))
    return rows.where(F.pmod(F.col("_k"), step) == 0).drop("_n", "_k")


LEARNERS = {"gbt": GBTClassifier, "forest": RandomForestClassifier, "logistic": LogisticRegression}


def fit(train: DataFrame, valid: DataFrame, label: str, numeric: list[str], categorical: list[str], learner: str = "gbt", **params):
    """A pipeline of indexed categories, filled numbers and a learner. Categories are those of the
    training and validation years; unseen ones get an index of their own. Boosted trees stop early
    on the validation year."""
    rows = train.withColumn("is_valid", F.lit(False)).unionByName(valid.withColumn("is_valid", F.lit(True))).where(F.col(label).isNotNull())
    rows = prepared(rows, label, numeric)
    stages = [
        StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep"),
        Imputer(inputCols=numeric, outputCols=[f"{c}_f" for c in numeric]),
        VectorAssembler(inputCols=[*[f"{c}_i" for c in categorical], *[f"{c}_f" for c in numeric], *[f"{c}_null" for c in numeric]], outputCol="features"),
    ]
    if learner == "gbt":
        params = {"maxIter": 20, "maxDepth": 5, "maxBins": 64, "seed": 7, "validationIndicatorCol": "is_valid"} | params
    model = LEARNERS[learner](featuresCol="features", labelCol=label, **params)
    rows = rows.persist()  # every stage and iteration reads them; a lost part is made again
    try:
        return Pipeline(stages=[*stages, model]).fit(rows)
    finally:
        rows.unpersist()


def prepared(df: DataFrame, label: str, numeric: list[str]) -> DataFrame:
    """Numbers as doubles, beside each whether it was null."""
    new = {f"{c}_null": F.col(c).isNull().cast("double") for c in numeric} | {c: F.col(c).cast("double") for c in numeric}
    return df.withColumns(new | {label: F.col(label).cast("double")})


def predict(model, df: DataFrame, label: str, numeric: list[str]) -> DataFrame:
    return model.transform(prepared(df, label, numeric)).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "prediction")


def gain_importance(spark: SparkSession, blocks: boost.Blocks, trees: dict[int, list[boost.Tree]]) -> DataFrame:
    """``fold, target, horizon, feature, gain, rank``: the summed gains of each feature's splits, greatest first."""
    found = spark.createDataFrame(boost.gains(blocks, trees), "fold string, target string, horizon string, feature string, gain double")
    rank = F.row_number().over(Window.partitionBy("fold", "target", "horizon").orderBy(F.desc("gain"), "feature"))
    return found.withColumn("rank", rank).orderBy("fold", "target", "horizon", "rank")


def permuted(df: DataFrame, column: str, seed: int, block: int = 4096) -> DataFrame:
    """``df`` with one column dealt anew. Rows are hashed into groups and two orders within each
    group are joined, so that no task sorts the whole table."""
    n_groups = F.pmod(F.xxhash64("leg_id"), F.lit(block))
    a, b = (Window.partitionBy("_g").orderBy(F.xxhash64(F.lit(seed + k), "leg_id"), "leg_id") for k in (0, 1))
    left = df.withColumn("_g", n_groups).withColumn("_i", F.row_number().over(a)).drop(column)
    right = df.select("leg_id", column).withColumn("_g", n_groups).withColumn("_i", F.row_number().over(b)).select("_g", "_i", column)
    return left.join(right, ["_g", "_i"]).drop("_g", "_i")


def permutation_importance(blocks: boost.Blocks, trees: dict[int, list[boost.Tree]], repeats: int = 3, seed: int = 0) -> DataFrame:
    """``target, horizon, feature, auc_drop, auc_drop_sd``: the fall of the area under the curve on the
    test rows as a feature is permuted, its mean and deviation over the repeats, greatest first. All
    features and repeats are one pass over the rows; a feature that no tree uses has no fall."""
    spark, named = blocks.rows.sparkSession, blocks.models()
    areas = materialised(boost.permuted_areas(blocks, trees, repeats, seed), "areas")  # a row for each feature and repeat
    base = areas.where("feature = ''").select("target", "horizon", F.col("auc").alias("base"))
    drops = areas.where("feature <> ''").join(base, ["target", "horizon"]).groupBy("target", "horizon", "feature").agg(F.avg(F.col("base") - F.col("auc")).alias("auc_drop"), F.stddev_pop(F.col("base") - F.col("auc")).alias("auc_drop_sd"))
    all_ = spark.createDataFrame([(*named[m][1:], blocks.features[f]) for m in trees for f in blocks.columns(m)], "target string, horizon string, feature string")
    zero = F.lit(0.0)
    found = all_.join(drops, ["target", "horizon", "feature"], "left").withColumns({c: F.coalesce(c, zero) for c in ("auc_drop", "auc_drop_sd")})
    return found.orderBy("target", "horizon", F.desc("auc_drop"), "feature")


def rolling_scores(rows: DataFrame, folds: list[Fold], targets: list[str], horizons: dict[str, list[str]], categorical: list[str], settings: boost.Settings | None = None) -> DataFrame:
    """``fold, target, horizon, id, y, p`` of the test rows of every fold under boosted trees for every
    target and horizon (a list of features, ``categorical`` among them), grown together."""
    settings = settings or boost.Settings()
    blocks = boost.binned(rows, folds, targets, horizons, categorical, settings)
    return boost.scores(blocks, boost.boost(blocks, settings))


def rolling_metrics(scored: DataFrame) -> DataFrame:
    """The metrics of each fold, target and horizon of ``rolling_scores``."""
    return binary_metrics(scored, "y", "p", ["fold", "target", "horizon"])


def fold_summary(results: DataFrame) -> DataFrame:
    """Least, median and greatest of each metric over the folds of a target and horizon."""
    metrics = ("auc", "pr_auc", "brier")
    least = [f.alias(f"{n}_{m}") for m in metrics for n, f in (("min", F.min(m)), ("median", F.percentile(m, F.lit(0.5))), ("max", F.max(m)))]
    return results.groupBy("target", "horizon").agg(F.count(F.lit(1)).alias("folds"), *least)


def scorecard(rows: DataFrame) -> DataFrame:
    """How near estimated coefficients are to published ones. ``rows``: table, name, b, se, b_pub,
    se_pub."""
    gap = F.abs(F.col("b") - F.col("b_pub")) / F.nullif(F.col("se_pub"), F.lit(0.0))
    ok = rows.withColumns({"gap": gap, "agrees": (F.signum("b") == F.signum("b_pub")).cast("int"), "se_ratio": ratio("se", "se_pub")})
    return ok.groupBy("table").agg(
        F.count("gap").alias("n_coefficients"), F.sum("agrees").alias("sign_agreement"), F.count_if(F.col("gap") < 0.5).alias("within_half_se"),
        F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.max("gap").alias("max_gap"), F.percentile("se_ratio", F.lit(0.5)).alias("median_se_ratio"),
    )


def sign_inversions(rows: DataFrame) -> DataFrame:
    """Coefficients whose sign turns between two estimators; zeros and missing ones are skipped.
    ``rows``: table, estimator (ols, iv), name, b."""
    wide = rows.groupBy("table", "name").agg(F.max(F.when(F.col("estimator") == "ols", F.col("b"))).alias("ols"), F.max(F.when(F.col("estimator") == "iv", F.col("b"))).alias("iv"))
    both = wide.where("ols is not null and iv is not null and ols <> 0 and iv <> 0")
    return both.groupBy("table").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.signum("ols") != F.signum("iv")).alias("n_inverted"))


def sign_bridge(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Estimated signs beside the expected ones (``name, sign``), a row a coefficient."""
    joined = rows.join(F.broadcast(expected), "name")
    return joined.select("table", "name", "sign", F.signum("b").cast("int").alias("found"), (F.signum("b") == F.col("sign")).alias("agrees"))
