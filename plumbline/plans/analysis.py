"""End-to-end analysis: features, group split, forest, verdicts."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import evaluation as ev

# Forest size, depth and seed. A node split needs four rows, so two per child.
TREES = 300
DEPTH = 12
MIN_ROWS_PER_CHILD = 2
FIT_TASKS = 2  # partitions of the training rows for each core


def feature_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if "__" in c]


def balanced(train: DataFrame) -> DataFrame:
    """Class weights n / (classes * rows of the class); two classes, so the counts are broadcast."""
    sizes = train.groupBy("state").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = sizes.join(F.broadcast(total)).select("state", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return train.join(F.broadcast(weights), "state").withColumn("label", (F.col("state") == "damaged").cast("double"))


def fit(train: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = ev.SEED) -> PipelineModel:
    """Fit the forest; its passes over the training rows read a persisted copy, spilled to disk as needed.

    Node ids are cached per row, so the growing forest is not shipped to every task on every level. Every partition
    sends the statistics of all nodes of a level, 50,000 and more, so there are only as many partitions as keep the cores busy.
    """
    names = feature_columns(train)
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=MIN_ROWS_PER_CHILD,
        seed=seed,
        cacheNodeIds=True,
        maxMemoryInMB=512,
    )
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error")
    cores = train.sparkSession.sparkContext.defaultParallelism
    rows = balanced(train).select(*names, "label", "weight").coalesce(FIT_TASKS * cores).persist()
    try:
        return Pipeline(stages=[assembler, forest]).fit(rows)
    finally:
        rows.unpersist()


def score(model: PipelineModel, table: DataFrame) -> DataFrame:
    out = model.transform(table)
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def importance(model: PipelineModel, names: list[str], model_id: str) -> DataFrame:
    """One row per feature; the vector is as long as the feature list."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray().tolist()
    spark = SparkSession.active()
    rows = list(zip([model_id] * len(names), names, values))
    return ev.rank_importance(spark.createDataFrame(rows, "model_id string, feature string, importance double"))


def train_and_score(table: DataFrame, **forest) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Split by measurement, fit on the train side and score the test side."""
    split = ev.group_split(table.select("measurement_id", "state"))
    sided = table.join(split.select("measurement_id", "side"), "measurement_id")
    train = sided.filter(F.col("side") == "train").drop("side")
    test = sided.filter(F.col("side") == "test").drop("side")
    model = fit(train, **forest)
    return model, score(model, test), split


def baseline_run(table: DataFrame, folder: str, model_id: str = "forest", **forest) -> None:
    """One fit to stored tables: features with their side, split, model, importance, scores, metrics and metadata.

    Features are written before anything reads them, so split, fit and scoring share one computation. So are the
    scores of the test side: every pass over them would ship the whole forest and score again.
    """
    spark = table.sparkSession
    table.write.mode("overwrite").parquet(f"{folder}/windows")
    windows = spark.read.parquet(f"{folder}/windows")
    split = ev.group_split(windows.select("measurement_id", "state"))
    split.write.mode("overwrite").parquet(f"{folder}/split")
    sides = spark.read.parquet(f"{folder}/split").select("measurement_id", "side")
    sided = windows.join(sides, "measurement_id")
    names = feature_columns(windows)
    model = fit(sided.filter(F.col("side") == "train").drop("side"), **forest)
    model.write().overwrite().save(f"{folder}/model")
    importance(model, names, model_id).write.mode("overwrite").parquet(f"{folder}/importance")
    score(model, sided.filter(F.col("side") == "test").drop("side")).write.mode("overwrite").parquet(f"{folder}/scores")
    scored = spark.read.parquet(f"{folder}/scores")
    ev.binary_metrics(ev.levels_of(scored)).write.mode("overwrite").parquet(f"{folder}/metrics")
    facts = [(model_id, ",".join(names), TREES, DEPTH, float(ev.THRESHOLD))]
    described = spark.createDataFrame(facts, "model_id string, features string, trees int, depth int, threshold double")
    described.write.mode("overwrite").parquet(f"{folder}/metadata")


def load_run(spark, folder: str) -> tuple[PipelineModel, DataFrame]:
    """The stored model and all windows; their features must be the model's."""
    windows = spark.read.parquet(f"{folder}/windows")
    wanted = spark.read.parquet(f"{folder}/metadata").first()["features"].split(",")
    if feature_columns(windows) != wanted:
        raise ValueError("the stored windows have other features than the model")
    return PipelineModel.load(f"{folder}/model"), windows
