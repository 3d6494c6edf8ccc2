"""Scores from reconstructions and densities: autoencoders, their mixtures, and
likelihood ratios. Networks are small numpy models fitted on a bounded sample;
scoring is Spark expressions or Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.functions.columns import col, cosine, relative_distance, top_share
from driftlane.functions.frames import spread
from driftlane.operators import networks
from driftlane.operators.projection import moments, project, vector

#: Rows on which a network is fitted.
SAMPLE = 20_000


def sample(df: DataFrame, features: list[str] | str, id_col: str, limit: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """``limit`` rows drawn by hash, as a matrix."""
    rows = df.select(F.col(id_col).alias("i"), vector(features).alias("v")).orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(limit).collect()
    return np.array([r.v for r in rows])


def feature_error(x: str | Column, recon: str | Column) -> Column:
    return F.zip_with(col(x), col(recon), lambda a, b: (a - b) * (a - b))


def instance_score(errors: str | Column, percent: float = 100.0) -> Column:
    """Mean of the largest ``percent`` % of feature errors."""
    return top_share(errors, percent)


def _scored_errors(df: DataFrame, auto: networks.Autoencoder, features: list[str] | str, percent: float, samples: int, seed: int) -> DataFrame:
    @F.pandas_udf("array<double>")
    def errors(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, len(auto.mean)))
        return pd.Series(list(((auto.reconstructions(x, samples, seed) - x[:, None]) ** 2).mean(1)))

    return df.withColumn("feature_score", errors(vector(features))).withColumn("score", instance_score("feature_score", percent))


def outlier_ae(df: DataFrame, ref: DataFrame, features: list[str] | str, hidden: int = 16, latent: int = 2, percent: float = 100.0, id_col: str = "id", epochs: int = 60, seed: int = 0, **training) -> DataFrame:
    """Adds ``feature_score`` (squared reconstruction errors) and ``score`` (their
    largest ``percent`` % on average) by an autoencoder fitted on a sample of the
    reference. ``training`` may set ``rate``, ``batch`` and ``optimiser``."""
    x = sample(ref, features, id_col, seed=seed)
    auto = networks.Autoencoder.make(x, hidden, latent, seed=seed).fit(x, epochs, seed, **training)
    return _scored_errors(df, auto, features, percent, 1, seed)


def outlier_vae(df: DataFrame, ref: DataFrame, features: list[str] | str, hidden: int = 16, latent: int = 2, percent: float = 100.0, id_col: str = "id", samples: int = 10, sigma: float = 0.5, beta: float = 1.0, epochs: int = 60, seed: int = 0, **training) -> DataFrame:
    """The same by a variational one, trained on the evidence bound: errors are means
    over ``samples`` codes that a row's values and the seed draw."""
    x = sample(ref, features, id_col, seed=seed)
    auto = networks.Autoencoder.make(x, hidden, latent, sigma, beta, seed).fit(x, epochs, seed, **training)
    return _scored_errors(df, auto, features, percent, samples, seed)


def outlier_aegmm(df: DataFrame, ref: DataFrame, features: list[str] | str, n_gmm: int = 2, hidden: int = 16, latent: int = 2, id_col: str = "id", samples: int = 1, sigma: float | None = None, beta: float = 1.0, w_energy: float = 0.1, w_cov: float = 0.005, epochs: int = 60, seed: int = 0, recon_features: Callable = networks.describe, **training) -> DataFrame:
    """Adds ``score``: the energy of (code, cosine, relative distance of the
    reconstruction), or of what ``recon_features`` gives, under a mixture that is trained together with the autoencoder on
    a sample of the reference. With ``sigma`` the autoencoder is variational and the
    score a mean over ``samples`` codes."""
    x = sample(ref, features, id_col, seed=seed)
    auto = networks.Autoencoder.make(x, hidden, latent, sigma, beta, seed)
    width = recon_features(x[:2], np.zeros((len(x[:2]), latent)), x[:2]).shape[1]
    model = networks.DensityAutoencoder(auto, networks.Network.make([width, hidden, n_gmm], seed + 2), w_energy, w_cov, recon_features).fit(x, epochs, seed, **training)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(model.energy(np.stack(v.to_numpy()).astype(float), samples, seed) if len(v) else np.zeros(0))

    return df.withColumn("score", score(vector(features)))


def outlier_vaegmm(df: DataFrame, ref: DataFrame, features: list[str] | str, samples: int = 10, sigma: float = 0.5, **kw) -> DataFrame:
    return outlier_aegmm(df, ref, features, samples=samples, sigma=sigma, **kw)


def pca_reconstruction(df: DataFrame, ref: DataFrame, features: list[str] | str, latent: int) -> DataFrame:
    """Adds ``recon``: a linear autoencoder's reconstruction, in expressions alone."""
    _, mean, cov = moments(ref, features)
    top = np.linalg.eigh(cov)[1][:, ::-1][:, :latent]
    back = project(project(vector(features), mean, top), np.zeros(latent), top.T)
    return df.withColumn("recon", F.zip_with(back, F.array(*map(F.lit, mean.tolist())), lambda x, m: x + m))


def energy_features(x: str | Column, recon: str | Column) -> Column:
    """[1 - cosine, relative distance up to 100] of a row and its reconstruction."""
    return F.array(1 - cosine(x, recon), F.least(relative_distance(x, recon), F.lit(100.0)))


def sequence_score(error: str | Column, estimate: str | Column, threshold: float | Column) -> Column:
    """Squared error less the estimated threshold of the state and the threshold."""
    return col(error) - col(estimate) - threshold


# -- likelihood ratio over sequences -------------------------------------------


def bigrams(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, prev, next``: consecutive characters of each text."""
    c, n = F.col("c"), F.size("c")
    chars = spread(df.select(id_col, text_col)).select(F.col(id_col).alias("id"), F.split(text_col, "").alias("c")).where(n > 1)
    pairs = F.explode(F.arrays_zip(F.slice(c, F.lit(1), n - 1).alias("prev"), F.slice(c, F.lit(2), n - 1).alias("next")))
    return chars.select("id", pairs.alias("p")).select("id", F.col("p")["prev"].alias("prev"), F.col("p")["next"].alias("next"))


def bigram_model(grams: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """``prev, next, logp``: log ((c + s) / (C(prev) + s V)), V the number of
    characters that follow any. From pairs, or from their counts ``c``."""
    counts = grams if "c" in grams.columns else grams.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("c"))
    vocab = counts.select("next").distinct().agg(F.count(F.lit(1)).alias("v"))
    total = F.sum("c").over(Window.partitionBy("prev"))
    return counts.withColumn("n", total).crossJoin(F.broadcast(vocab)).select("prev", "next", F.ln((F.col("c") + smoothing) / (F.col("n") + smoothing * F.col("v"))).alias("logp"))  # one row


def mutated(df: DataFrame, id_col: str, text_col: str, rate: float, alphabet: str = "abcdefghijklmnopqrstuvwxyz ", seed: int = 0) -> DataFrame:
    """Each character becomes, with probability ``rate``, one of ``alphabet``: what a
    background model learns from. Chances come from a hash of id and place."""
    at = lambda salt, i: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(id_col), i), F.lit(1 << 30))
    letters = F.array(*map(F.lit, alphabet))
    moved = F.transform(F.split(text_col, ""), lambda c, i: F.when(at(1, i) < int(rate * (1 << 30)), F.get(letters, F.pmod(at(2, i), F.lit(len(alphabet))).cast("int"))).otherwise(c))
    return df.withColumn(text_col, F.array_join(moved, ""))


def likelihood_ratio_steps(df: DataFrame, semantic: DataFrame, background: DataFrame, id_col: str = "doc_id", text_col: str = "text", unseen: float = -20.0) -> DataFrame:
    """``id_col, step, score``: the ratio of each character after the first."""
    c, n = F.col("c"), F.size("c")
    chars = df.select(F.col(id_col).alias("id"), F.split(text_col, "").alias("c")).where(n > 1)
    own = chars.select("id", F.posexplode(F.arrays_zip(F.slice(c, F.lit(1), n - 1).alias("prev"), F.slice(c, F.lit(2), n - 1).alias("next"))).alias("step", "p")).select("id", "step", "p.prev", "p.next")
    out = own.join(semantic.toDF("prev", "next", "s"), ["prev", "next"], "left").join(background.toDF("prev", "next", "b"), ["prev", "next"], "left")
    return out.select(F.col("id").alias(id_col), "step", (F.coalesce("b", F.lit(unseen)) - F.coalesce("s", F.lit(unseen))).alias("score"))


#: Character pairs of both models up to which they go with the scoring function.
PAIRS = 1 << 20

#: A pair of characters as one number: the first one's code point times this, plus the second's.
_CODES = 1 << 21


def _slices(rows: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Rows of a batch, with texts of about so many bytes at a time."""
    upto, at = np.cumsum(pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield rows.slice(at, end - at)
        at = end


def _pair_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of all texts one after the other, where each text's begin, and how many they are."""
    points = [np.frombuffer((t or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts.to_pylist()]
    size = np.array([max(len(p) - 1, 0) for p in points], np.int64)
    pairs = [p[:-1].astype(np.int64) * _CODES + p[1:] for p in points if len(p) > 1]
    return np.concatenate(pairs or [np.zeros(0, np.int64)]), np.cumsum(size) - size, size


def _dense(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the place of each among them; few characters make
    this a look-up and not a sort."""
    held = np.zeros(_CODES, np.int32)
    held[codes // _CODES] = 1
    held[codes % _CODES] = 1
    chars = np.flatnonzero(held)
    if len(chars) > 1024:
        return np.unique(codes, return_inverse=True)
    held[chars] = np.arange(len(chars))
    grid = held[codes // _CODES] * np.int64(len(chars)) + held[codes % _CODES]
    there = np.bincount(grid, minlength=len(chars) ** 2) > 0
    found = np.flatnonzero(there)
    return chars[found // len(chars)] * np.int64(_CODES) + chars[found % len(chars)] if len(chars) else codes, (np.cumsum(there) - 1)[grid]


def pair_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``prev, next, c``: how often characters follow each other in a table's texts,
    counted a batch at a time."""

    def work(batches):
        for b in (part for rows in batches for part in _slices(rows, 0)):
            codes, at = _dense(_pair_codes(b.column(0))[0])
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(np.bincount(at, minlength=len(codes)), pa.int64())], ["code", "c"])

    counts = spread(df.select(F.col(text_col).cast("binary").alias("t"))).mapInArrow(work, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))
    char = F.udf(chr, "string")  # a call for each distinct pair
    return counts.select(char(F.floor(F.col("code") / _CODES)).alias("prev"), char(F.pmod("code", F.lit(_CODES))).alias("next"), "c")


def likelihood_ratio(df: DataFrame, semantic: DataFrame, background: DataFrame, id_col: str = "doc_id", text_col: str = "text", unseen: float = -20.0) -> DataFrame:
    """``id_col, score`` = -(log p semantic - log p background) of each text.

    Both models are tables of character pairs. Up to ``PAIRS`` of them go with the
    function that scores texts; more meet the pairs of each text, counted before, in
    a join.
    """
    s, b = F.coalesce("s", F.lit(unseen)), F.coalesce("b", F.lit(unseen))
    models = semantic.toDF("prev", "next", "s").join(background.toDF("prev", "next", "b"), ["prev", "next"], "full").select("prev", "next", (b - s).alias("w"))
    few = models.limit(PAIRS + 1).toArrow()
    if few.num_rows > PAIRS:
        own = bigrams(df, id_col, text_col).groupBy("id", "prev", "next").agg(F.count(F.lit(1)).alias("k"))
        out = own.join(semantic.toDF("prev", "next", "s"), ["prev", "next"], "left").join(background.toDF("prev", "next", "b"), ["prev", "next"], "left")
        return out.groupBy(F.col("id").alias(id_col)).agg((-F.sum(F.col("k") * (s - b))).alias("score"))
    codes = np.array([ord(p) * _CODES + ord(q) for p, q in zip(few.column("prev").to_pylist(), few.column("next").to_pylist())], np.int64)
    order = np.argsort(codes)
    codes, weights = np.append(codes[order], np.iinfo(np.int64).max), np.append(few.column("w").to_numpy()[order], 0.0)

    def work(batches):
        for rows in (part for batch in batches for part in _slices(batch, 1)):
            own, begin, size = _pair_codes(rows.column(1))
            known, at = _dense(own)
            spot = np.searchsorted(codes, known)
            each = np.where(codes[spot] == known, weights[spot], 0.0)[at]  # a pair that neither model has counts the same in both
            on = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(on)), pa.array(np.add.reduceat(each, begin[on]) if len(on) else np.zeros(0))], ["id", "score"])

    texts = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")))
    out = texts.mapInArrow(work, f"id {dict(df.dtypes)[id_col]}, score double")
    return out.groupBy(F.col("id").alias(id_col)).agg(F.sum("score").alias("score"))
