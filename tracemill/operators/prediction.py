"""Prefix datasets, simple models and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import BY_NAME, Classifier, EventLog, seconds
from ..runtime import cut
from .ranges import with_sum_before
from .variants import labelled

NO_MORE = "⟂"


def prefix_rows(log: EventLog, min_prefix: int = 1, max_prefix: int = 20, classifier: Classifier = BY_NAME) -> DataFrame:
    """One row per case and prefix length: case_id, case_start, prefix_length, prefix, next_activity, outcome, remaining_hours."""
    own = W.partitionBy("case_id").orderBy("at")
    whole = W.partitionBy("case_id").orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = labelled(log, classifier).select(
        "case_id",
        F.first("ts").over(whole).alias("case_start"),
        (F.col("at") + 1).alias("prefix_length"),
        "label",
        F.coalesce(F.lead("label").over(own), F.lit(NO_MORE)).alias("next_activity"),
        F.last("label").over(whole).alias("outcome"),
        (seconds(F.col("ts"), F.last("ts").over(whole)) / 3600).alias("remaining_hours"),
    )
    # prefixes are gathered from the rows that are asked for only
    rows = rows.filter(F.col("prefix_length") <= max_prefix)
    prefix = F.collect_list("label").over(W.partitionBy("case_id").orderBy("prefix_length").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.select("case_id", "case_start", "prefix_length", prefix.alias("prefix"), "next_activity", "outcome", "remaining_hours")
    return rows.filter(F.col("prefix_length") >= min_prefix)


def next_steps(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """One row per event, however long its case: case_id, last (its activity), next_activity."""
    following = F.lead("label").over(W.partitionBy("case_id").orderBy("at"))
    return labelled(log, classifier).select("case_id", F.col("label").alias("last"), F.coalesce(following, F.lit(NO_MORE)).alias("next_activity"))


def frequency_features(rows: DataFrame, activities: list[str]) -> DataFrame:
    """Columns: count of each activity, prefix length, and whether each activity is the last one."""
    is_ = lambda a: lambda x: x == a
    counts = [F.size(F.filter("prefix", is_(a))).alias(f"count {a}") for a in activities]
    last = F.try_element_at("prefix", F.lit(-1))
    flags = [F.when(last == a, 1).otherwise(0).alias(f"last is {a}") for a in activities]
    return rows.select("*", *counts, F.col("prefix_length").alias("length"), *flags)


def index_features(rows: DataFrame, activities: list[str], width: int) -> DataFrame:
    """features: index of each of the last ``width`` activities, -1 in front of short prefixes."""
    index = F.create_map(*(F.lit(x) for k, a in enumerate(activities) for x in (a, k)))
    last = F.slice("prefix", F.greatest(F.size("prefix") - width + 1, F.lit(1)), F.lit(width))
    coded = F.transform(last, lambda x: F.coalesce(F.try_element_at(index, x), F.lit(-1)))
    return rows.withColumn("features", F.concat(F.array_repeat(F.lit(-1), F.lit(width) - F.size(coded)), coded))


def one_hot_features(rows: DataFrame, activities: list[str], width: int) -> DataFrame:
    """features: index features as ``width`` blocks of zeros and ones."""
    n = len(activities)
    coded = index_features(rows, activities, width)
    block = lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == i, 1).otherwise(0))
    return coded.withColumn("features", F.flatten(F.transform("features", block)))


def split_by_time(rows: DataFrame, train_fraction: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by case start, undated cases last; no case is in both.

    The cut is found from counts of cases per start, and only the starts' own table is ordered. Cases and the ids of those
    to train on are written, as both are read several times.
    """
    cases = cut(rows.select("case_id", "case_start").distinct(), "cases")
    late = F.coalesce(F.unix_micros("case_start"), F.lit((1 << 63) - 1))
    starts = cases.groupBy(late.alias("t")).agg(F.count("*").alias("n"))
    placed = with_sum_before(starts, [F.col("t")], "n", "above").select("t", "above")
    total = cases.agg(F.greatest(F.bround(F.count("*") * F.lit(train_fraction), 0), F.lit(1)).alias("cut"))
    tie = W.partitionBy("t").orderBy("case_id")
    ranked = cases.withColumn("t", late).join(placed, "t").withColumn("rank", F.col("above") + F.row_number().over(tie)).crossJoin(F.broadcast(total))
    train = cut(ranked.filter("rank <= cut").select("case_id"), "train-cases")
    return rows.join(train, "case_id", "left_semi"), rows.join(train, "case_id", "left_anti")


def fit_frequency(train: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Most frequent label (or mean of a number) per key, and over all rows; ties go to the smaller label."""
    if dict(train.dtypes)[label] in ("double", "float", "int", "bigint"):
        return train.groupBy(key).agg(F.avg(label).alias("predicted")), train.agg(F.avg(label).alias("otherwise"))
    mode = lambda df, *by: df.groupBy(*by, label).agg(F.count("*").alias("n")).groupBy(*by).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("predicted"))
    return mode(train, key), mode(train).withColumnRenamed("predicted", "otherwise")


def predict_frequency(rows: DataFrame, model: tuple[DataFrame, DataFrame], key: str) -> DataFrame:
    by_key, overall = model
    return rows.join(by_key, key, "left").crossJoin(F.broadcast(overall)).withColumn("predicted", F.coalesce("predicted", "otherwise")).drop("otherwise")  # one row


def evaluate(predicted: DataFrame, label: str) -> DataFrame:
    """prefix_length (null for all), rows, score: accuracy, or mean absolute error of a number."""
    number = dict(predicted.dtypes)[label] in ("double", "float", "int", "bigint")
    score = F.avg(F.abs(F.col("predicted") - F.col(label))) if number else F.avg((F.col("predicted") == F.col(label)).cast("double"))
    return predicted.groupingSets([["prefix_length"], []], "prefix_length").agg(F.count("*").alias("rows"), score.alias("score"))


def forest(train: DataFrame, features: list[str], label: str, trees: int = 20, seed: int = 7):
    """A fitted random-forest pipeline of Spark's own library: a classifier for text labels, a regressor for numbers. Features and label are written once, as fitting reads them several times."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    train = cut(train.select(*features, label), "forest")
    gather = VectorAssembler(inputCols=features, outputCol="vector", handleInvalid="keep")
    if dict(train.dtypes)[label] == "double":
        return Pipeline(stages=[gather, RandomForestRegressor(featuresCol="vector", labelCol=label, predictionCol="predicted", numTrees=trees, seed=seed)]).fit(train)
    index = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep").fit(train)
    model = RandomForestClassifier(featuresCol="vector", labelCol="label_index", predictionCol="index", numTrees=trees, seed=seed)
    back = IndexToString(inputCol="index", outputCol="predicted", labels=index.labels)
    return Pipeline(stages=[gather, index, model, back]).fit(train)
