"""Risk classifiers with Spark ML: forest, one-vs-rest boosted trees, fold predictions, scoring, persistence.

The model matrix is the ordered 14 features.  Training data is written once
to the shared checkpoint folder, so the iterative tree passes re-read a
stable table rather than the raw scan (and an executor loss costs one
parquet re-read).  Scoring is a single ``transform`` over every row of a
batch or streaming DataFrame.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.operators import evaluate
from tremorlake.operators.features import model_matrix
from tremorlake.session import materialize

LABEL_IDX = "label_idx"


def standardize(df: DataFrame, cols: list[str], ddof: int = 0) -> DataFrame:
    """(x - mean) / std per column; ddof 0 = population std (scikit-learn), 1 = Spark ML's sample std."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[std(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    # a constant column is centred and left at scale 1
    return df.withColumns({c: (F.col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(cols)})


def with_class_weights(df: DataFrame, label: str = "risk_label") -> DataFrame:
    """Attach the balanced weight n / (k * n_c) of each row's class; rows without a label are an error."""
    weights = {r[label]: r["weight"] for r in evaluate.class_weights(df, label).select(label, "weight").collect()}
    if None in weights:
        raise ValueError(f"rows without {label}: fill or filter them before training")
    if not weights:
        raise ValueError("no training rows")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return df.withColumn("weight", table[F.col(label)])


def _indexer() -> StringIndexer:
    return StringIndexer(inputCol="risk_label", outputCol=LABEL_IDX, stringOrderType="alphabetAsc")


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=K.FEATURES, outputCol="features", handleInvalid="keep")


def training_matrix(df: DataFrame, keep: list[str] | None = None, rows_per_partition: int = 250_000) -> DataFrame:
    """Features + label, written once as parquet for the iterative fits, + class weight.

    The learners draw their samples per partition, so rows are dealt by a hash
    of their content to one partition per ``rows_per_partition`` rows (4 at
    least) and sorted there: the same rows give the same model whatever the
    number of cores or files.
    """
    table = materialize(model_matrix(df, keep=keep), "train")
    parts = max(4, -(-table.count() // rows_per_partition))
    row = F.xxhash64(*[F.col(c) for c in table.columns])
    dealt = (with_class_weights(table).withColumn("_row", row).repartition(parts, "_row")
             .sortWithinPartitions("_row", *K.FEATURES).drop("_row"))
    return dealt


def fit_forest(train: DataFrame, num_trees: int = K.FOREST_PARAMS["numTrees"],
               max_depth: int = K.FOREST_PARAMS["maxDepth"], max_bins: int = 256,
               max_cached_ids: int = 150_000_000) -> PipelineModel:
    rf = RandomForestClassifier(featuresCol="features", labelCol=LABEL_IDX, weightCol="weight",
                                numTrees=num_trees, maxDepth=max_depth,
                                minInstancesPerNode=K.FOREST_PARAMS["minInstancesPerNode"],
                                featureSubsetStrategy="sqrt", maxBins=max_bins, seed=K.SEED,
                                # execution only: larger node groups per pass, and node ids cached while they
                                # are few (a number per row and tree, written anew for every group of nodes;
                                # walking down from the root gives the same ids)
                                maxMemoryInMB=1024, cacheNodeIds=train.count() <= max_cached_ids // num_trees,
                                checkpointInterval=10)
    return Pipeline(stages=[_indexer(), _assembler(), rf]).fit(train)


@dataclass
class BoostedModel:
    """One binary gradient-boosted model per class; probabilities normalised to sum to 1."""

    prep: PipelineModel
    members: list = field(default_factory=list)  # (class name, GBTClassificationModel)

    @property
    def labels(self) -> list[str]:
        return [c for c, _ in self.members]

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.prep.transform(df)
        for i, (_, m) in enumerate(self.members):
            m = m.copy()
            m.setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_prob{i}").setPredictionCol(f"_pred{i}")
            out = m.transform(out)
        ps = [vector_to_array(F.col(f"_prob{i}"))[1] for i in range(len(self.members))]
        tot = ps[0]
        for p in ps[1:]:
            tot = tot + p
        arr = F.array(*[p / tot for p in ps])
        drop = [c for i in range(len(self.members)) for c in (f"_raw{i}", f"_prob{i}", f"_pred{i}")]
        return out.withColumn("prob_array", arr).drop(*drop)


def fit_boosted(train: DataFrame, max_iter: int = K.BOOSTED_PARAMS["maxIter"], max_bins: int = 256,
                rows_at_once: int = 2_000_000) -> BoostedModel:
    """Multiclass boosting as three one-vs-rest ``GBTClassifier`` fits (no OneVsRest: it has no probabilities).

    Each fit caches its binned rows and errors, so as many run at once as have ``rows_at_once`` rows together
    (one at least).
    """
    prep = Pipeline(stages=[_indexer(), _assembler()]).fit(train)
    labels = prep.stages[0].labels
    data = prep.transform(train)

    def fit_one(k: int):
        y = data.withColumn("_y", (F.col(LABEL_IDX) == k).cast("double"))
        gbt = GBTClassifier(featuresCol="features", labelCol="_y", maxIter=max_iter, maxBins=max_bins,
                            stepSize=K.BOOSTED_PARAMS["stepSize"], maxDepth=K.BOOSTED_PARAMS["maxDepth"],
                            subsamplingRate=K.BOOSTED_PARAMS["subsamplingRate"],
                            featureSubsetStrategy=K.BOOSTED_FEATURE_FRACTION, seed=K.SEED,
                            # six steps down a tree cost less than a new table of node ids per level
                            cacheNodeIds=False, checkpointInterval=10)
        return gbt.fit(y)

    fitted = in_parallel(fit_one, range(len(labels)), max_workers=max(1, rows_at_once // max(1, train.count())))
    return BoostedModel(prep, list(zip(labels, fitted)))


def in_parallel(fn, items, max_workers: int = 5) -> list:
    """Run independent fits as concurrent Spark jobs from a small driver thread pool (results in order).

    Each item gets its own copy of the caller's job properties: fits that share one overwrite each other's execution id.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    items = list(items)
    with ThreadPoolExecutor(max_workers=max(1, min(max_workers, len(items)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(fn), x) for x in items]]


def _prob_array(model, df: DataFrame) -> tuple[DataFrame, list[str]]:
    if isinstance(model, BoostedModel):
        return model.transform(df), model.labels
    out = model.transform(df)
    return out.withColumn("prob_array", vector_to_array(F.col("probability"))), model.stages[0].labels


def predict(model, df: DataFrame, model_name: str, keep: list[str] | None = None) -> DataFrame:
    """Score every row: risk_level, confidence, per-class probabilities (4 decimals), model_used."""
    keep = keep or []
    m = model_matrix(df, keep=keep, with_label=False)
    out, labels = _prob_array(model, m)
    probs = {c: (F.col("prob_array")[labels.index(c)] if c in labels else F.lit(0.0)) for c in K.CLASSES}
    label, conf = evaluate.argmax_label([probs[c] for c in K.CLASSES])
    rounded = {c: F.round(p, 4) for c, p in probs.items()}
    return out.select(
        *keep, label.alias("risk_level"), F.round(conf, 4).alias("confidence"),
        F.create_map(*[x for c in K.CLASSES for x in (F.lit(c), rounded[c])]).alias("probabilities"),
        *[rounded[c].alias(f"prob_{c}") for c in [K.NORMAL, K.WARNING, K.CRITICAL]],
        F.lit(model_name).alias("model_used"))


def fold_predictions(train: DataFrame, fold_col: str, fit, n_folds: int = K.N_FOLDS,
                     rows_at_once: int = 2_000_000) -> DataFrame:
    """Out-of-fold predictions: fit on the other folds (with their own class weights), predict the held-out one, unite.

    Each fit caches its bagged rows, so as many run at once as have ``rows_at_once`` rows together (one at least).
    """
    models = in_parallel(lambda k: fit(with_class_weights(train.where(F.col(fold_col) != k).drop("weight"))),
                         range(n_folds), max_workers=min(5, max(1, rows_at_once // max(1, train.count()))))
    out = None
    for k, m in enumerate(models):
        p, labels = _prob_array(m, train.where(F.col(fold_col) == k))
        lab, _ = evaluate.argmax_label([
            (F.col("prob_array")[labels.index(c)] if c in labels else F.lit(0.0)) for c in K.CLASSES])
        p = p.select("risk_label", lab.alias("prediction"), F.lit(k).alias("fold"))
        out = p if out is None else out.unionByName(p)
    return out


def feature_importance(model, top: int = 10) -> list[tuple[str, float]]:
    """Top features by impurity importance (forest) or the mean over the one-vs-rest members."""
    if isinstance(model, BoostedModel):
        vecs = [m.featureImportances.toArray() for _, m in model.members]
        imp = [sum(v[i] for v in vecs) / len(vecs) for i in range(len(K.FEATURES))]
    else:
        imp = list(model.stages[-1].featureImportances.toArray())
    ranked = sorted(zip(K.FEATURES, imp), key=lambda t: (-t[1], t[0]))
    return ranked[:top]


def ppv_leak_probe(df: DataFrame, label: str = "risk_label", ppv: str = "ppv_mms", max_bins: int = 4096):
    """Depth-2 tree on PPV alone: accuracy above 0.98 means the label is a PPV threshold (leak)."""
    d = df.select(F.col(ppv).cast("double").alias("ppv"), F.col(label).alias("risk_label")).where("ppv IS NOT NULL")
    pipe = Pipeline(stages=[_indexer(), VectorAssembler(inputCols=["ppv"], outputCol="features"),
                            DecisionTreeClassifier(featuresCol="features", labelCol=LABEL_IDX,
                                                   maxDepth=K.LEAK_TREE_DEPTH, maxBins=max_bins, seed=K.SEED)])
    pred = pipe.fit(d).transform(d)
    acc = pred.agg(F.avg((F.col("prediction") == F.col(LABEL_IDX)).cast("double")).alias("accuracy"))
    return acc.withColumn("leak_detected", F.col("accuracy") > F.lit(K.LEAK_ACCURACY))


def save(model, path: str, name: str, metrics: dict, spark: SparkSession) -> None:
    """Model directory + one-row JSON metadata (name, classes, features, metrics)."""
    if isinstance(model, BoostedModel):
        model.prep.write().overwrite().save(f"{path}/prep")
        for i, (_, m) in enumerate(model.members):
            m.write().overwrite().save(f"{path}/member{i}")
        labels = model.labels
    else:
        model.write().overwrite().save(f"{path}/pipeline")
        labels = model.stages[0].labels
    meta = {"model_name": name, "kind": "boosted" if isinstance(model, BoostedModel) else "forest",
            "classes": labels, "feature_names": K.FEATURES, "metrics": metrics}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str):
    """Load a saved model; fails if the directory is absent."""
    from pyspark.ml.classification import GBTClassificationModel

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["kind"] == "boosted":
        prep = PipelineModel.load(f"{path}/prep")
        members = [(c, GBTClassificationModel.load(f"{path}/member{i}")) for i, c in enumerate(meta["classes"])]
        return BoostedModel(prep, members), meta
    return PipelineModel.load(f"{path}/pipeline"), meta


def score(model, df: DataFrame, model_name: str, keep: list[str] | None = None) -> DataFrame:
    """Batch or streaming scoring with the metadata echo (node_id, timestamp) of each packet."""
    from tremorlake.operators.clean import echo_metadata

    d = echo_metadata(df)
    return predict(model, d, model_name, keep=list(dict.fromkeys((keep or []) + ["node_id", "timestamp"])))
