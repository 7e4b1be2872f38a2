"""A linear model of dense features: statistics in Spark, the small fit on the driver."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a fit takes at most; more are refused rather than sampled.
MOST_ROWS = 200_000


def split_of(doc, seed: int = 7):
    """train, calibration or test by the document's hash: 70, 15 and 15 of 100."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}\0"), doc), 256), 1, 16), 16, 10).cast("decimal(20,0)") % 100
    return F.when(h < 70, "train").when(h < 85, "calibration").otherwise("test")


def fit_linear(rows: DataFrame, epochs: int = 600, rate: float = 0.2, l2: float = 1e-3, seed: int = 7) -> dict:
    """Softmax regression on rows (id, features array, label): standardised, weighted by class, by gradient descent."""
    if rows.count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows to fit on")
    df = rows.orderBy("id").toPandas()
    x, labels = np.array(df["features"].tolist(), float), df["label"].to_numpy()
    classes, y = np.unique(labels, return_inverse=True)
    mean, std = x.mean(0), x.std(0)
    std = np.where(std < 1e-8, 1.0, std)
    z, onehot = (x - mean) / std, np.eye(len(classes))[y]
    weight = len(y) / (len(classes) * onehot.sum(0))
    weight = (weight / weight.mean())[y]
    w, b = np.random.default_rng(seed).normal(0, 1e-6, (len(classes), x.shape[1])), np.zeros(len(classes))
    for epoch in range(epochs):
        s = z @ w.T + b
        p = np.exp(s - s.max(1, keepdims=True))
        g = weight[:, None] * (p / p.sum(1, keepdims=True) - onehot) / len(y)
        step = rate / np.sqrt(1 + epoch / 100)
        w, b = w - step * (g.T @ z + l2 * w), b - step * g.sum(0)
    folded = w / std
    model = {"classes": classes.tolist(), "weights": folded.tolist(), "bias": (b - folded @ mean).tolist(), "temperature": 1.0}
    return model | {"fingerprint": fingerprint(model)}


def fingerprint(model: dict) -> str:
    """SHA-256 of the model's compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(model, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def predict_linear(rows: DataFrame, model: dict) -> DataFrame:
    """id, top, p1, p2 of rows (id, features array); the weights are constants of the expression."""
    scores = [
        F.aggregate(F.zip_with("features", F.array(*map(F.lit, w)), lambda a, c: a.cast("double") * c), F.lit(float(b)), lambda s, v: s + v) / F.lit(model["temperature"])
        for w, b in zip(model["weights"], model["bias"])
    ]
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("o"), F.lit(c).alias("c")) for s, c in zip(scores, model["classes"])]))
    out = rows.select("id", ranked.alias("r"))
    z = F.aggregate("r", F.lit(0.0), lambda s, v: s + F.exp(F.greatest(F.col("r")[0]["o"] - v["o"], F.lit(-745.0))))
    return out.select("id", F.col("r")[0]["c"].alias("top"), (1 / z).alias("p1"), F.coalesce(F.exp(F.col("r")[0]["o"] - F.try_element_at("r", F.lit(2))["o"]) / z, F.lit(0.0)).alias("p2"))
