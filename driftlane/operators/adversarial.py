"""Adversarial scores: differences between two models' class probabilities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.functions.columns import argmax, cross_entropy, kl, sharpen
from driftlane.operators.thresholds import percentile_threshold
from driftlane.operators import networks, recon
from driftlane.operators.projection import vector


def adversarial_score(p: str | Column, q: str | Column, temperature: float = 1.0, hidden: list[tuple[Column, Column, float]] | None = None) -> Column:
    """KL of the model's probabilities on a row and on its reconstruction, the first
    sharpened; plus weighted divergences of hidden layers."""
    first = sharpen(p, temperature) if temperature != 1 else (F.col(p) if isinstance(p, str) else p)
    out = kl(first, q)
    for a, b, weight in hidden or []:
        out = out + weight * kl(a, b)
    return out


def distillation_score(p: str | Column, q: str | Column, loss: str = "kld", temperature: float = 1.0) -> Column:
    """Divergence or cross entropy of a model and its distilled one."""
    first = sharpen(p, temperature) if temperature != 1 else (F.col(p) if isinstance(p, str) else p)
    return {"kld": kl, "xent": cross_entropy}[loss](first, q)


def threshold_with_margin(df: DataFrame, score: str, percent: float = 99.0, margin: float = 0.0) -> DataFrame:
    return percentile_threshold(df, score, percent).select((F.col("threshold") + margin).alias("threshold"))


def correct(df: DataFrame, score: str, threshold: float, p: str, q: str) -> DataFrame:
    """Adds ``is_adversarial, no_defense, defense, corrected`` classes."""
    out = df.withColumn("is_adversarial", (F.col(score) > threshold).cast("int")).withColumn("no_defense", argmax(p)).withColumn("defense", argmax(q))
    return out.withColumn("corrected", F.when(F.col("is_adversarial") == 1, F.col("defense")).otherwise(F.col("no_defense")))


# -- what is trained for these scores ------------------------------------------


def probabilities(model: Callable[[np.ndarray], np.ndarray], features: list[str] | str) -> Column:
    """Class probabilities of a function of rows, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(model(np.stack(v.to_numpy()).astype(float))) if len(v) else [])

    return run(vector(features))


def fit_classifier(df: DataFrame, features: list[str] | str, label: str, hidden: int = 16, id_col: str = "id", epochs: int = 60, seed: int = 0, **training) -> networks.Network:
    """A network of logits for labels 0, 1, .., fitted on a bounded sample by hash."""
    rows = recon.sample(df.select(F.col(id_col), F.array_append(vector(features), F.col(label).cast("double")).alias("__v")), "__v", id_col, seed=seed)
    return networks.classifier(rows[:, :-1], rows[:, -1].astype(int), hidden, epochs, seed, **training)


def adversarial_ae(df: DataFrame, ref: DataFrame, features: list[str] | str, model: networks.Network, hidden: int = 16, latent: int = 4, temperature: float = 1.0, w_recon: float = 0.0, id_col: str = "id", epochs: int = 60, seed: int = 0, **training) -> DataFrame:
    """Adds ``probs``, ``recon_probs`` and ``score``: the model's probabilities on a row
    and on its reconstruction by an autoencoder that was trained on a sample of the
    reference to keep them, and their divergence."""
    auto = networks.defender(recon.sample(ref, features, id_col, seed=seed), model, hidden, latent, w_recon=w_recon, temperature=temperature, epochs=epochs, seed=seed, **training)
    own, back = (lambda x: networks.softmax(model(x))), (lambda x: networks.softmax(model(auto.reconstructions(x)[:, 0])))
    out = df.withColumn("probs", probabilities(own, features)).withColumn("recon_probs", probabilities(back, features))
    return out.withColumn("score", adversarial_score("probs", "recon_probs", temperature))


def model_distillation(df: DataFrame, ref: DataFrame, features: list[str] | str, model: networks.Network, hidden: int = 8, temperature: float = 1.0, loss: str = "kld", id_col: str = "id", epochs: int = 60, seed: int = 0, **training) -> DataFrame:
    """The same with a smaller network that was trained on a sample of the reference
    to give the model's probabilities."""
    student = networks.distilled(recon.sample(ref, features, id_col, seed=seed), model, hidden, temperature, epochs, seed, **training)
    own, other = (lambda x: networks.softmax(model(x))), (lambda x: networks.softmax(student(x)))
    out = df.withColumn("probs", probabilities(own, features)).withColumn("recon_probs", probabilities(other, features))
    return out.withColumn("score", distillation_score("probs", "recon_probs", loss, temperature))
