"""Classifiers as Spark ML pipelines behind one registry."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.metrics import best_epoch, confusion_counts, overall
from packetloom.operators.sampling import with_sample_weight

LABEL, CODE, WEIGHT = "label", "_code", "weight"
RAW, SCALED, MARGIN, VOTES = "_raw_features", "_features", "_margin_", "_votes_"
#: Training values (rows times features) of one task. A job of a round costs the same however few rows its tasks have.
TASK_VALUES = 4_000_000


def _forest(seed: int, classes: int, width: int, trees: int = 100, depth: int = 20, weighted: bool = True, parallel: int = 8):
    model = RandomForestClassifier(
        featuresCol=RAW, labelCol=CODE, maxDepth=depth, cacheNodeIds=True, maxMemoryInMB=128, checkpointInterval=10,
    )
    return ForestParts(model.setWeightCol(WEIGHT) if weighted else model, trees, seed, parallel), False


class ForestParts(Estimator):
    """One forest, grown as smaller ones side by side: trees do not depend on each other. :func:`predict` adds up their votes.

    Every task fills statistics for all nodes that are split at once, mostly empty ones deep down; the parts share
    that work out over the cluster even where the rows are few."""

    def __init__(self, classifier: RandomForestClassifier, trees: int, seed: int, parallel: int):
        super().__init__()
        self.classifier, self.trees, self.seed, self.parallel = classifier, trees, seed, parallel

    def _fit(self, rows: DataFrame) -> PipelineModel:
        parts = min(self.parallel, self.trees)

        def train(k: int):
            own = self.classifier.copy().setNumTrees(self.trees // parts + (k < self.trees % parts)).setSeed(self.seed * parts + k)
            own = own.setRawPredictionCol(f"{VOTES}{k}").setProbabilityCol(f"_probability_{k}").setPredictionCol(f"_prediction_{k}")
            return own.fit(rows)

        with ThreadPool(parts) as pool:
            return PipelineModel(pool.map(inheritable_thread_target(rows.sparkSession)(train), range(parts)))


def _boosted(
    seed: int, classes: int, width: int, rounds: int = 600, depth: int = 6, held_out: str | None = None, tolerance: float = 0.01,
    parallel: int = 8,
):
    """Boosted trees of every class against the rest. With ``held_out``, a boolean column, those rows are not trained on:
    the trees of a class end where their loss on the held-out rows no longer falls by ``tolerance`` (of the loss),
    so one fit per class finds its number of rounds."""
    trees = GBTClassifier(featuresCol=RAW, weightCol=WEIGHT, maxIter=rounds, maxDepth=depth, stepSize=0.08, subsamplingRate=0.85, seed=seed)
    if held_out:
        trees = trees.setParams(validationIndicatorCol=held_out, validationTol=tolerance)
    return EachClass(trees, classes, parallel), False


class EachClass(Estimator):
    """One binary model per class, a few at a time; :func:`predict` takes the class with the greatest margin."""

    def __init__(self, classifier: GBTClassifier, classes: int, parallel: int):
        super().__init__()
        self.classifier, self.classes, self.parallel = classifier, classes, parallel

    def _fit(self, rows: DataFrame) -> PipelineModel:
        def train(k: int):
            own = self.classifier.copy().setLabelCol("_own").setRawPredictionCol(f"{MARGIN}{k}")
            own = own.setProbabilityCol(f"_probability_{k}").setPredictionCol(f"_prediction_{k}")
            return own.fit(rows.withColumn("_own", (F.col(CODE) == k).cast("double")))

        # a round is many short jobs: the classes' jobs fill the cluster together
        with ThreadPool(min(self.parallel, self.classes)) as pool:
            return PipelineModel(pool.map(inheritable_thread_target(rows.sparkSession)(train), range(self.classes)))


def _bayes(seed: int, classes: int, width: int):
    return NaiveBayes(featuresCol=SCALED, labelCol=CODE, modelType="gaussian"), True


def _logistic(seed: int, classes: int, width: int, rounds: int = 100, penalty: float = 1e-4):
    return LogisticRegression(
        featuresCol=SCALED, labelCol=CODE, weightCol=WEIGHT, family="multinomial", maxIter=rounds, regParam=penalty,
    ), True


def _svm(seed: int, classes: int, width: int, rounds: int = 100, penalty: float = 1e-4):
    margin = LinearSVC(featuresCol=SCALED, labelCol=CODE, maxIter=rounds, regParam=penalty)
    # a hundred rounds of short jobs per class: the classes' jobs fill the cluster together
    return OneVsRest(classifier=margin, featuresCol=SCALED, labelCol=CODE, weightCol=WEIGHT, parallelism=min(classes, 8)), True


def _perceptron(seed: int, classes: int, width: int, rounds: int = 100, weights: DenseVector | None = None):
    """``weights`` of an earlier model of the same layers: training goes on from there."""
    model = MultilayerPerceptronClassifier(
        featuresCol=SCALED, labelCol=CODE, layers=[width, 128, 64, classes], maxIter=rounds, seed=seed,
    )
    return (model if weights is None else model.setInitialWeights(weights)), True


TRAINERS: dict[str, Callable] = {
    "rf": _forest, "xgb": _boosted, "gnb": _bayes, "logreg": _logistic, "svm": _svm, "mlp": _perceptron,
}


def fit(name: str, train: DataFrame, features: Sequence[str] | str, seed: int = 42, **options) -> PipelineModel:
    """Train one registered model. ``features`` are columns, or one vector column.

    Rows are weighted to balance the classes; pass ``weighted=False`` to the forest
    for the data set that is trained without.
    """
    if name not in TRAINERS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(TRAINERS)}")
    with _kept(train, features, options.get("held_out")) as (rows, stages, classes, width):
        model, scaled = TRAINERS[name](seed, classes, width, **options)
        return Pipeline(stages=[*stages, *([_scaler()] if scaled else []), model]).fit(rows)


def _scaler() -> StandardScaler:
    return StandardScaler(inputCol=RAW, outputCol=SCALED, withMean=True, withStd=True)


@contextmanager
def _kept(train: DataFrame, features: Sequence[str] | str, held_out: str | None = None):
    """Weighted rows, the stages that code their labels and make their vectors, and the numbers of classes and features."""
    rows = with_sample_weight(train, LABEL)
    # Read many times below: kept in memory or on disk, recomputed if an executor goes.
    vector = isinstance(features, str)
    extra = [held_out] if held_out else []
    rows = (rows.withColumnRenamed(features, RAW) if vector else rows).select(LABEL, WEIGHT, *extra, *([RAW] if vector else features))
    width = len(rows.select(RAW).first()[0]) if vector else len(features)
    rows = rows.repartition(max(1, math.ceil(train.count() * width / TASK_VALUES))).persist()
    try:
        indexer = StringIndexer(inputCol=LABEL, outputCol=CODE, stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
        stages: list = [indexer]
        if not vector:
            stages.append(VectorAssembler(inputCols=list(features), outputCol=RAW))
        yield rows, stages, len(indexer.labels), width
    finally:
        rows.unpersist()


def predict(model: PipelineModel, rows: DataFrame, features: Sequence[str] | str | None = None) -> DataFrame:
    """``y_true`` and ``y_pred`` beside the columns of ``rows``."""
    source = rows.withColumnRenamed(features, RAW) if isinstance(features, str) else rows
    indexer = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    scored = model.transform(source)
    if "prediction" not in scored.columns:
        votes = [c for c in scored.columns if c.startswith(VOTES)]
        if votes:
            scored = scored.withColumns({v: vector_to_array(v) for v in votes})
            margins = F.array(*[sum((F.col(v)[k] for v in votes), F.lit(0.0)) for k in range(len(indexer.labels))])
        else:
            margins = F.array(*[vector_to_array(f"{MARGIN}{k}")[1] for k in range(len(indexer.labels))])
        scored = scored.withColumn("prediction", (F.array_position(margins, F.array_max(margins)) - 1).cast("double"))
    named = IndexToString(inputCol="prediction", outputCol="y_pred", labels=list(indexer.labels)).transform(scored)
    keep = [c for c in rows.columns if c != features]
    return named.select(*keep, F.col(LABEL).alias("y_true"), "y_pred")


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Forest feature importances, highest first."""
    parts = model.stages[-1].stages
    values = sum(p.featureImportances.toArray() * p.getNumTrees for p in parts) / sum(p.getNumTrees for p in parts)
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def train_on(
    train: DataFrame, valid: DataFrame, features: Sequence[str] | str, seed: int, step: int = 10, most: int = 200, patience: int = 2,
) -> tuple[PipelineModel, DataFrame]:
    """A perceptron trained ``step`` rounds at a time from its last weights, and its history by epoch (one per step).

    Training ends after ``patience`` epochs without a better macro-F1 on ``valid``; the best epoch's model is returned.
    Earlier rounds are never repeated, and the rows are weighed, coded and scaled once for all epochs.
    """
    history, models, weights = [], [], None
    with _kept(train, features) as (rows, stages, classes, width):
        ready = Pipeline(stages=[*stages, _scaler()]).fit(rows)
        scaled = ready.transform(rows).select(CODE, SCALED).persist()
        try:
            for epoch in range(most // step):
                own = TRAINERS["mlp"](seed, classes, width, rounds=step, weights=weights)[0].fit(scaled)
                model, weights = PipelineModel([*ready.stages, own]), own.weights
                scored = overall(confusion_counts(predict(model, valid, features))).first()
                history.append((epoch, (epoch + 1) * step, float(scored["macro_f1"])))
                models.append(model)
                best = max(range(epoch + 1), key=lambda e: (history[e][2], -e))
                if epoch - best >= patience:
                    break
        finally:
            scaled.unpersist()
    table = train.sparkSession.createDataFrame(history, "epoch int, rounds int, val_macro_f1 double")
    return models[best_epoch(table, patience).first()["best_epoch"]], table


def run_models(
    names: Sequence[str], train: DataFrame, test: DataFrame, features, seed: int = 42,
    save_to: str | None = None, dry_run: bool = False, options: dict[str, dict] | None = None,
) -> DataFrame | list[str]:
    """Train the chosen models and stack their test predictions under ``model``."""
    unknown = [n for n in names if n not in TRAINERS]
    if unknown:
        raise ValueError(f"unknown models {unknown}; known: {sorted(TRAINERS)}")
    if dry_run:
        return list(names)
    stacked = None
    for name in names:
        model = fit(name, train, features, seed, **(options or {}).get(name, {}))
        if save_to:
            model.write().overwrite().save(f"{save_to}/{name}")
        scored = predict(model, test, features).select("y_true", "y_pred").withColumn("model", F.lit(name))
        stacked = scored if stacked is None else stacked.unionByName(scored)
    return stacked


def model_summary(stacked: DataFrame) -> DataFrame:
    """One row per model: accuracy, macro and weighted F1, rows."""
    return overall(confusion_counts(stacked, ["model"]), ["model"]).orderBy(F.desc("macro_f1"), "model")
