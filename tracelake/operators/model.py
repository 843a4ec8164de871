"""Training, freezing, scoring and explaining forests and boosted trees."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyspark
from pyspark.errors import AnalysisException
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelake.operators import boosting
from tracelake.operators.profile import classification_metrics
from tracelake.operators.sample import stratified_split
from tracelake.operators.trees import Tree, shapley

#: Rows that are explained at a time: contributions by row, feature and class, and products along paths, are held for these alone.
EXPLAINED = 500


class ModelIntegrityError(Exception):
    """The saved model is not the one that its manifest names."""


@dataclass(frozen=True)
class Trained:
    model: RandomForestClassificationModel | boosting.Boosted
    features: list[str]
    classes: list[str]
    metrics: dict[str, float]


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="error").transform(df)


def _split(df: DataFrame, category: str, key: str, test: float, seed: int) -> tuple[DataFrame, list[str]]:
    """The rows with ``is_test`` and ``__y``, the number of their class in order of names."""
    classes = sorted(r[0] for r in df.select(category).distinct().collect())
    if len(classes) < 2:
        raise ValueError("two classes are needed to train")
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(category)) - 1
    return stratified_split(df, category, key, test=test, seed=seed).withColumn("__y", number.cast("double")), classes


def train(df: DataFrame, features: list[str], category: str, key: str, *, trees: int = 60, depth: int = 6, test: float = 0.2, seed: int = 42) -> Trained:
    """Fits a forest on four fifths of each class and measures on the rest; classes are numbered in order of their names."""
    split, classes = _split(df, category, key, test, seed)
    rows = _vectors(split, features)
    forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(rows.where(~F.col("is_test")))
    tested = model.transform(rows.where("is_test"))
    metrics = classification_metrics(tested, F.col("__y"), F.col("prediction")).first().asDict()
    return Trained(model, features, classes, metrics)


def train_boosted(df: DataFrame, features: list[str], category: str, key: str, *, rounds: int = 50, depth: int = 4, test: float = 0.2, seed: int = 42, **options) -> Trained:
    """The same with boosted trees, on as many classes as there are; ``options`` are those of ``boosting.fit``."""
    rows, classes = _split(df, category, key, test, seed)
    model = boosting.fit(rows.where(~F.col("is_test")), features, "__y", classes, rounds=rounds, depth=depth, **options)
    best = F.array_position(_probabilities(model, features), F.array_max(_probabilities(model, features))) - 1
    metrics = classification_metrics(rows.where("is_test").withColumn("__best", best.cast("double")), F.col("__y"), F.col("__best")).first().asDict()
    return Trained(model, features, classes, metrics)


def _probabilities(model: boosting.Boosted, features: list[str]) -> Column:
    """Class probabilities of boosted trees, an Arrow batch at a time. The model's size is bounded by its parameters."""

    @F.pandas_udf("array<double>")
    def scored(x: pd.Series) -> pd.Series:
        rows = np.array([[np.nan if v is None else v for v in r] for r in x], float).reshape(-1, len(features))
        return pd.Series(list(model.probabilities(rows)))

    return scored(F.array(*[F.col(f"`{f}`").cast("double") for f in features]))


def _saved_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted relative names and digests of a saved model's data files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    rows = files.select("path", F.sha2("content", 256).alias("h")).collect()
    parts = sorted((r.path.split(path.rstrip("/").rsplit("/", 1)[-1] + "/", 1)[-1], r.h) for r in rows)
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def certify(spark: SparkSession, trained: Trained, folder: str, version: str) -> dict:
    """Saves the model and a manifest with its hash, features, classes and metrics."""
    path = f"{folder}/model_{version}"
    boosted = isinstance(trained.model, boosting.Boosted)
    if boosted:
        spark.createDataFrame(trained.model.table(), boosting.NODES).coalesce(1).write.mode("overwrite").parquet(path)
    else:
        trained.model.write().overwrite().save(path)
    manifest = {
        "version": version,
        "model_hash": _saved_hash(spark, path),
        "feature_names": trained.features,
        "class_names": trained.classes,
        "metrics": trained.metrics,
        "trained_at": datetime.now(timezone.utc).isoformat(),
        "library_version": f"spark {pyspark.__version__}",
        "kind": "boosted" if boosted else "forest",
    }
    if boosted:
        manifest["start"] = trained.model.start.tolist()
    text = json.dumps(manifest, ensure_ascii=False, indent=1)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/model_{version}.manifest.json")
    return manifest


def next_version(existing: list[str]) -> str:
    """The smallest free vN."""
    n = 1
    while f"v{n}" in existing:
        n += 1
    return f"v{n}"


class FrozenClassifier:
    """A certified model; loading fails if it is not what its manifest says."""

    def __init__(self, spark: SparkSession, folder: str, version: str):
        try:
            lines = spark.read.option("wholetext", True).text(f"{folder}/model_{version}.manifest.json").collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            raise FileNotFoundError(f"no manifest of model {version} in {folder}") from error
        self.manifest = json.loads("".join(r.value for r in lines))
        path = f"{folder}/model_{version}"
        if _saved_hash(spark, path) != self.manifest["model_hash"]:
            raise ModelIntegrityError(f"model {version} differs from its manifest")
        self.version, self.features, self.classes = version, self.manifest["feature_names"], self.manifest["class_names"]
        if self.manifest.get("kind") == "boosted":
            self.model = boosting.from_table(spark.read.schema(boosting.NODES).parquet(path).collect(), self.features, self.classes, self.manifest["start"])
        else:
            self.model = RandomForestClassificationModel.load(path)

    def _scored(self, df: DataFrame) -> DataFrame:
        """Adds ``__p``, the class probabilities, and ``__label``, the number of the likeliest class, the first of equal ones."""
        if isinstance(self.model, boosting.Boosted):
            scored = df.withColumn("__p", _probabilities(self.model, self.features))
            return scored.withColumn("__label", F.array_position("__p", F.array_max("__p")) - 1)
        scored = self.model.setFeaturesCol("__x").setPredictionCol("__label").transform(_vectors(df, self.features))
        return scored.withColumn("__p", vector_to_array("probability")).drop("__x", "rawPrediction", "probability")

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: label, probability, model version, category and all class probabilities."""
        scored, p = self._scored(df), F.col("__p")
        names = F.array(*[F.lit(c) for c in self.classes])
        best = F.col("__label").cast("int")
        prediction = F.struct(
            best.alias("label"),
            F.get(p, best).alias("probability"),
            F.lit(self.version).alias("model_version"),
            F.get(names, best).alias("attack_cat"),
            F.map_from_arrays(names, p).alias("class_probabilities"),
        )
        return scored.withColumn("prediction", prediction).drop("__p", "__label")

    def explain(self, df: DataFrame, n: int = 10) -> DataFrame:
        """Adds ``top_features``: the n largest contributions to the predicted class, by absolute value.

        They are contributions to its probability for a forest, and to its margin for boosted trees. df must have ``prediction``.
        The model is broadcast: its trees have at most 2**(depth + 1) nodes each.
        """
        forest = df.sparkSession.sparkContext.broadcast(self.model if isinstance(self.model, boosting.Boosted) else Forest.of(self.model))
        features = self.features

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for low in range(0, len(whole), EXPLAINED):
                    batch = whole.iloc[low : low + EXPLAINED].copy()
                    x, label = batch[features].to_numpy(float), batch["__label"].to_numpy(int)
                    phi = forest.value.contributions(x)[np.arange(len(x)), :, label]
                    order = np.argsort(-np.abs(phi), axis=1, kind="stable")[:, :n]
                    batch["top_features"] = [[{"feature": features[j], "shap_value": float(row[j])} for j in o] for row, o in zip(phi, order)]
                    yield batch.drop(columns="__label")

        kinds = df.drop("prediction").schema.simpleString()[7:-1]
        flat = df.select(*[F.col(f"`{c}`") for c in df.columns if c != "prediction"], F.col("prediction.label").alias("__label"), F.to_json("prediction").alias("__p"))
        out = flat.mapInPandas(run, f"{kinds}, __p: string, top_features: array<struct<feature: string, shap_value: double>>")
        return out.withColumn("prediction", F.from_json("__p", df.schema["prediction"].dataType)).drop("__p")


@dataclass(frozen=True)
class Forest:
    """Trees whose values are class probabilities."""

    trees: list[Tree]

    @staticmethod
    def of(model: RandomForestClassificationModel) -> Forest:
        trees = []
        for tree in model.trees:
            rows: list[list] = []

            def walk(node) -> int:
                at = len(rows)
                stats = np.array(node.impurityStats().stats())
                rows.append([-1, 0.0, -1, -1, stats.sum(), stats / stats.sum()])
                if node.subtreeDepth() > 0:
                    rows[at][:2] = node.split().featureIndex(), node.split().threshold()
                    rows[at][2] = walk(node.leftChild())
                    rows[at][3] = walk(node.rightChild())
                return at

            walk(tree._call_java("rootNode"))
            trees.append(Tree(*[np.array(c) for c in zip(*rows)]))
        return Forest(trees)

    def base(self) -> np.ndarray:
        """Mean class probabilities over the training rows."""
        return np.mean([t.expected() for t in self.trees], axis=0)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values by row, feature and class; with ``base`` they add up to the forest's probabilities."""
        out = np.zeros((*x.shape, self.trees[0].value.shape[1]))
        for tree in self.trees:
            out += shapley(tree, x)
        return out / len(self.trees)
