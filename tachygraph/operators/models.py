"""Scaling, model configuration and registry, training and prediction, losses and window metrics."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.pipeline import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tachygraph.operators.quantiles import exact_quantiles

STEPS = 55
#: The deepest trees that the forest can grow.
MAX_DEPTH = 30
#: Tensors that are handled at once.
TENSOR_ROWS = 256


@dataclass(frozen=True)
class ModelConfig:
    """What a model must be told; event_filter_id has no default."""

    event_filter_id: int
    model_name: str = "RandomForest"
    prediction_threshold: float = 0.5
    scaler: str | None = "robust"
    exclude_feats_idxs: tuple[int, ...] = ()
    dataset_ids: tuple[str, ...] = ()
    n_cross_validation_folds: int = 5
    input_shape: tuple[int, int] = (STEPS, 38)
    class_weights: tuple[float, float] = (1.0, 1.0)
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if len(self.input_shape) != 2 or len(self.class_weights) != 2:
            raise ValueError("input_shape and class_weights are pairs")
        if self.scaler not in (None, "robust"):
            raise ValueError(f"unknown scaler {self.scaler!r}")


class Model(ABC):
    """A model that is fitted on (features..., label) and scores rows."""

    def __init__(self, config: ModelConfig):
        self.config = config

    @abstractmethod
    def fit(self, rows: DataFrame, features: list[str]) -> Model: ...

    @abstractmethod
    def predict(self, rows: DataFrame) -> DataFrame: ...

    @abstractmethod
    def save(self, path: str) -> None: ...

    @abstractmethod
    def load_internals(self, path: str) -> Model: ...


MODELS: dict[str, Callable[[ModelConfig], Model]] = {}


def create(config: ModelConfig) -> Model:
    if config.model_name not in MODELS:
        raise ValueError(f"unknown model {config.model_name!r}")
    return MODELS[config.model_name](config)


def robust_parameters(rows: DataFrame, features: list[str], bins: int = 4096) -> DataFrame:
    """(feature, centre, scale): median and interquartile range, exact; a range of 0 scales by 1."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("x.*")
    q = exact_quantiles(long, "feature", "v", (0.25, 0.5, 0.75), bins)
    spread = F.col("q")[F.lit(0.75)] - F.col("q")[F.lit(0.25)]
    return q.select("feature", F.col("q")[F.lit(0.5)].alias("centre"), F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))


def robust_scaled(rows: DataFrame, features: list[str], parameters: DataFrame) -> DataFrame:
    """``rows`` with each feature less its centre, over its scale. One row of parameters is joined, whatever the rows."""
    wide = parameters.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("centre", "scale")))).alias("p_"))
    joined = rows.join(F.broadcast(wide))
    return joined.withColumns({f: (F.col(f) - F.col("p_")[f]["centre"]) / F.col("p_")[f]["scale"] for f in features}).drop("p_")


class _Spark(Model):
    stages: PipelineModel | None = None

    def _classifier(self):
        raise NotImplementedError

    def fit(self, rows: DataFrame, features: list[str]) -> Model:
        w0, w1 = self.config.class_weights
        data = rows.withColumn("weight_", F.when(F.col("label") == 1, w1).otherwise(w0))
        self.stages = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x_", handleInvalid="skip"), self._classifier()]).fit(data)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with ``score``, the probability of label 1; 0 before fitting."""
        if self.stages is None:
            return rows.withColumn("score", F.lit(0.0))
        return self.stages.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("x_", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(path)

    def load_internals(self, path: str) -> Model:
        self.stages = PipelineModel.load(path)
        return self


class RandomForest(_Spark):
    def _classifier(self):
        p = self.config.params
        return RandomForestClassifier(
            featuresCol="x_", labelCol="label", weightCol="weight_", seed=p.get("random_state", 42), numTrees=p.get("n_estimators", 100),
            maxDepth=min(p.get("max_depth") or MAX_DEPTH, MAX_DEPTH), minInstancesPerNode=p.get("min_samples_leaf") or 1,
            featureSubsetStrategy=str(p.get("max_features") or "auto"),
        )


class Logistic(_Spark):
    def _classifier(self):
        return LogisticRegression(featuresCol="x_", labelCol="label", weightCol="weight_", regParam=self.config.params.get("reg", 0.01))


MODELS |= {"RandomForest": RandomForest, "Logistic": Logistic}


def transformer_pooled(x: np.ndarray, w: dict[str, np.ndarray], layers: int, heads: int) -> np.ndarray:
    """(n, steps, features) to (n, d): projection and ReLU, encoder layers with the norm after each part, max over steps."""

    def norm(y: np.ndarray, k: str) -> np.ndarray:
        return (y - y.mean(-1, keepdims=True)) / np.sqrt(y.var(-1, keepdims=True) + 1e-5) * w[f"{k}.g"] + w[f"{k}.b"]

    h = np.maximum(x @ w["in.w"] + w["in.b"], 0)
    for k in range(layers):
        n, s, d = h.shape
        q, key, v = (h @ w[f"{k}.{p}.w"] + w[f"{k}.{p}.b"] for p in "qkv")
        q, key, v = (y.reshape(n, s, heads, d // heads).transpose(0, 2, 1, 3) for y in (q, key, v))
        a = q @ key.transpose(0, 1, 3, 2) / np.sqrt(d // heads)
        a = np.exp(a - a.max(-1, keepdims=True))
        mixed = (a / a.sum(-1, keepdims=True) @ v).transpose(0, 2, 1, 3).reshape(n, s, d)
        h = norm(h + mixed @ w[f"{k}.o.w"] + w[f"{k}.o.b"], f"{k}.n1")
        h = norm(h + np.maximum(h @ w[f"{k}.f1.w"] + w[f"{k}.f1.b"], 0) @ w[f"{k}.f2.w"] + w[f"{k}.f2.b"], f"{k}.n2")
    return h.max(axis=1)


def transformer_scores(x: np.ndarray, w: dict[str, np.ndarray], layers: int, heads: int) -> np.ndarray:
    """Scores of (n, steps, features): the pooled steps and a linear end."""
    return 1 / (1 + np.exp(-(transformer_pooled(x, w, layers, heads) @ w["out.w"] + w["out.b"]).ravel()))


def transformer_weights(features: int, d: int = 64, ff: int = 128, layers: int = 1, seed: int = 42) -> dict[str, np.ndarray]:
    """Weights of the right shapes, drawn by a fixed seed; trained ones are loaded into the same names."""
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}

    def linear(name: str, a: int, b: int) -> None:
        w[f"{name}.w"], w[f"{name}.b"] = rng.normal(0, a**-0.5, (a, b)), np.zeros(b)

    linear("in", features, d)
    for k in range(layers):
        for p in ("q", "k", "v", "o"):
            linear(f"{k}.{p}", d, d)
        linear(f"{k}.f1", d, ff)
        linear(f"{k}.f2", ff, d)
        for p in ("n1", "n2"):
            w[f"{k}.{p}.g"], w[f"{k}.{p}.b"] = np.ones(d), np.zeros(d)
    linear("out", d, 1)
    return w


def transformer_predict(tensors: DataFrame, weights: dict[str, np.ndarray], layers: int = 1, heads: int = 1, pooled: bool = False) -> DataFrame:
    """(record_id, row, score) of rows with ``x``: array of steps, each an array of features; in Arrow batches. With ``pooled``, what the linear end is given instead."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k in range(0, len(pdf), TENSOR_ROWS):
                part = pdf.iloc[k : k + TENSOR_ROWS]
                x = np.nan_to_num(np.array([np.stack(list(r)) for r in part["x"]], float))
                got = list(transformer_pooled(x, weights, layers, heads)) if pooled else transformer_scores(x, weights, layers, heads)
                yield pd.DataFrame({"record_id": part["record_id"], "row": part["row"], "got": got})

    kind = "pooled array<double>" if pooled else "score double"
    return tensors.select("record_id", "row", "x").mapInPandas(lambda frames: (f.rename(columns={"got": kind.split()[0]}) for f in run(frames)), f"record_id long, row long, {kind}")


class Transformer(Model):
    """The encoder on tensors ``x`` (``feature_tensor``). Its end, the linear layer on the pooled steps, is trained; the encoder's weights are drawn
    by a seed or loaded. params: d_model, d_ff, n_layers, n_heads, random_state, reg."""

    def __init__(self, config: ModelConfig):
        super().__init__(config)
        p = config.params
        self.layers, self.heads = p.get("n_layers", 1), p.get("n_heads", 1)
        self.weights = transformer_weights(config.input_shape[1], p.get("d_model", 64), p.get("d_ff", 128), self.layers, p.get("random_state", 42))

    def fit(self, rows: DataFrame, features: list[str] | None = None) -> Model:
        """``rows``: record_id, row, x, label. Without rows the weights stay as they are."""
        if rows.isEmpty():
            return self
        w0, w1 = self.config.class_weights
        pooled = transformer_predict(rows, self.weights, self.layers, self.heads, pooled=True)
        data = pooled.join(rows.select("record_id", "row", "label"), ["record_id", "row"]).withColumn("weight_", F.when(F.col("label") == 1, w1).otherwise(w0))
        end = LogisticRegression(featuresCol="x_", labelCol="label", weightCol="weight_", regParam=self.config.params.get("reg", 0.01)).fit(data.withColumn("x_", array_to_vector("pooled")))
        self.weights = self.weights | {"out.w": end.coefficients.toArray().reshape(-1, 1), "out.b": np.array([end.intercept])}
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return transformer_predict(rows, self.weights, self.layers, self.heads)

    def save(self, path: str) -> None:
        """One row for each array of weights."""
        rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in self.weights.items()]
        SparkSession.active().createDataFrame(rows, "name string, shape array<int>, weights array<double>").write.mode("overwrite").parquet(path)

    def load_internals(self, path: str) -> Model:
        rows = SparkSession.active().read.parquet(path).collect()
        self.weights = {r["name"]: np.array(r["weights"]).reshape(r["shape"]) for r in rows}
        return self


MODELS["Transformer"] = Transformer


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def legacy_score(probability: Column) -> Column:
    """A probability through a sigmoid once more, as some stored scores are."""
    return sigmoid(probability)


def weighted_bce(logit: Column, label: Column, positive_weight: float) -> Column:
    """The loss of one row: cross-entropy of a logit, times the weight for positives."""
    loss = F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))
    return loss * F.when(label == 1, positive_weight).otherwise(1.0)


def window_sensitivity(score: Column, label: Column, threshold: float) -> Column:
    """Aggregate: share of positives above (not at) the threshold, to three places; 0 without positives."""
    hits = F.count_if((score > threshold) & (label == 1))
    return F.coalesce(F.round(F.try_divide(hits, F.count_if(label == 1)), 3), F.lit(0.0))
