"""Faults put into data, samples with a set share of outliers, image corruptions.

Random choices come from a hash of a row's key and a seed: they repeat whatever
the partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.functions.frames import number, uniform
from driftlane.operators.timeseries import local_deviation


def normal(seed: int, *keys: str | Column) -> Column:
    a, b = uniform(seed, *keys), uniform(seed + 7919, *keys)
    return F.sqrt(-2 * F.ln(1 - a)) * F.cos(2 * math.pi * b)


#: Ranges of hashes among which the n-th is looked for.
RANGES = 1 << 14


def pick(df: DataFrame, n: int, key: str, seed: int, label: str = "picked") -> DataFrame:
    """Marks exactly the ``n`` rows of least hash (all, if fewer).

    Counts of hash ranges, a row each, tell the range of the n-th hash; only the keys
    of that range are sorted. Of rows that share the last key as many are marked as
    are wanted, by a hash of their values."""
    held = df.select(uniform(seed, key).alias("o"), F.col(key).alias("k")).withColumn("b", F.floor(F.col("o") * RANGES))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    counts = held.groupBy("b").agg(F.count(F.lit(1)).alias("c")).select("b", (F.lit(n) - F.sum("c").over(upto) + F.col("c")).alias("rest"))  # how many are wanted from here on
    last = F.broadcast(counts.where("rest > 0").orderBy(F.desc("b")).limit(1))  # one row
    upto = Window.partitionBy("b").orderBy("o", "k").rowsBetween(Window.unboundedPreceding, 0)
    keys = held.join(last, "b").groupBy("b", "rest", "o", "k").agg(F.count(F.lit(1)).alias("c")).withColumn("rest", F.col("rest") - F.sum("c").over(upto) + F.col("c"))
    found = keys.where("rest > 0").orderBy(F.desc("o"), F.desc("k")).select(F.struct("o", "k").alias("e"), "rest", "c").limit(1)
    edge = found.collect()  # one row
    if not edge:
        return df.withColumn(label, F.lit(0))
    spot = F.struct(uniform(seed, key).alias("o"), F.col(key).alias("k"))
    with_edge = df.crossJoin(F.broadcast(df.sparkSession.createDataFrame(edge, found.schema).select("e")))
    marked = with_edge.withColumn(label, (spot <= F.col("e")).cast("int"))
    if edge[0].rest < edge[0].c:
        values = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
        shares = F.col(key).eqNullSafe(F.col("e.k"))
        own = number(with_edge.where(shares), values, 64, name="__n").withColumn(label, (F.col("__n") < edge[0].rest).cast("int")).drop("__n")
        marked = marked.where(~shares).unionByName(own)
    return marked.drop("e")


def _push(value: Column, dev: Column, r: Column, n_std: float, min_std: float) -> Column:
    return value + F.signum(r) * F.greatest(F.abs(r * n_std), F.lit(min_std)) * dev


def inject_tabular(df: DataFrame, features: list[str], percent: float, n_std: float, min_std: float, key: str, seed: int = 0) -> DataFrame:
    """``percent`` % of rows, exactly, move by a random multiple of each feature's
    population deviation; ``is_outlier`` marks them."""
    rows, *devs = df.agg(F.count(F.lit(1)), *[F.stddev_pop(f) for f in features]).first()
    out = pick(df, int(rows * percent / 100), key, seed, "is_outlier")
    for i, f in enumerate(features):
        moved = _push(F.col(f), F.lit(devs[i]), normal(seed + 1 + i, key), n_std, min_std)
        out = out.withColumn(f, F.when(F.col("is_outlier") == 1, moved).otherwise(F.col(f)))
    return out


def inject_ts(df: DataFrame, value: str, order: str, percent: float, n_std: float, min_std: float, series: str, window: int = 10, seed: int = 0) -> DataFrame:
    """As above, by the deviation of the ``window`` values on either side in a series.
    A series is sorted in one task, so a table should have many."""
    n = df.count()
    dev = local_deviation(value, order, window, window - 1, series)
    out = pick(df.withColumn("__dev", dev), int(n * percent / 100), order, seed, "is_outlier")
    moved = _push(F.col(value), F.col("__dev"), normal(seed + 1, order), n_std, min_std)
    return out.withColumn(value, F.when(F.col("is_outlier") == 1, moved).otherwise(F.col(value))).drop("__dev")


def inject_categorical(df: DataFrame, feature: str, farthest: dict, percent: float, key: str, seed: int = 0) -> DataFrame:
    """``percent`` % of rows take the category farthest from their own."""
    n = df.count()
    table = F.create_map(*[F.lit(x) for kv in farthest.items() for x in kv])
    out = pick(df, int(n * percent / 100), key, seed, "is_outlier")
    return out.withColumn(feature, F.when(F.col("is_outlier") == 1, F.coalesce(F.try_element_at(table, feature), F.col(feature))).otherwise(F.col(feature)))


def mutate(code: str, rate: float, top: int, key: str, seed: int = 0) -> Column:
    """With probability ``rate`` a code moves to another one of 0 .. top."""
    moved = F.pmod(F.col(code) + 1 + F.floor(uniform(seed + 1, key) * top), F.lit(top + 1)).cast("int")
    return F.when(uniform(seed, key) < rate, moved).otherwise(F.col(code))


def outlier_batch(df: DataFrame, target: str, n: int, percent: float, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, ``percent`` % of them outliers; with replacement only
    where a class has fewer rows than asked."""
    bad = int(percent * 0.01 * n)
    counts = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    parts = []
    for label, want in ((0, n - bad), (1, bad)):
        rows = df.where(F.col(target) == label)
        have = counts.get(label, 0)
        if have and want:
            if full := want // have:
                parts.append(rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(full)))).drop("__copy"))
            if want % have:
                parts.append(pick(rows, want % have, key, seed, "__picked").where("__picked = 1").drop("__picked"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- images: struct<height, width, channels, data: array<double>>, values 0 to 255 --


def _blur(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Convolution of each channel, edges reflected."""
    r, c = kernel.shape[0] // 2, kernel.shape[1] // 2
    p = np.pad(x, ((r, r), (c, c), (0, 0)), mode="symmetric")
    out = np.zeros_like(x)
    for i in range(kernel.shape[0]):
        for j in range(kernel.shape[1]):
            if kernel[i, j]:
                out += kernel[i, j] * p[i : i + x.shape[0], j : j + x.shape[1]]
    return out


def gaussian_kernel(sigma: float) -> np.ndarray:
    r = max(1, int(4 * sigma + 0.5))
    a = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.outer(a, a) / a.sum() ** 2


def disk_kernel(radius: int, alias: float = 0.5) -> np.ndarray:
    r = max(8, radius)
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    k = (x**2 + y**2 <= radius**2).astype(float)
    return _blur((k / k.sum())[:, :, None], gaussian_kernel(alias))[:, :, 0]


def resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    i, j = np.linspace(0, x.shape[0] - 1, h), np.linspace(0, x.shape[1] - 1, w)
    a, b = np.floor(i).astype(int), np.floor(j).astype(int)
    a2, b2 = np.minimum(a + 1, x.shape[0] - 1), np.minimum(b + 1, x.shape[1] - 1)
    u, v = (i - a)[:, None, None], (j - b)[None, :, None]
    return (1 - u) * ((1 - v) * x[a][:, b] + v * x[a][:, b2]) + u * ((1 - v) * x[a2][:, b] + v * x[a2][:, b2])


def clipped_zoom(x: np.ndarray, factor: float) -> np.ndarray:
    h, w = x.shape[:2]
    ch, cw = math.ceil(h / factor), math.ceil(w / factor)
    a, b = (h - ch) // 2, (w - cw) // 2
    return resize(x[a : a + ch, b : b + cw], h, w)


def plasma(size: int, decay: float, rng: np.random.Generator) -> np.ndarray:
    """Midpoint displacement on a square of a power of two, scaled to 0 .. 1."""
    n = 1
    grid = rng.uniform(size=(2, 2))
    wobble = 1.0
    while n < size:
        big = resize(grid[:, :, None], 2 * n + 1, 2 * n + 1)[:, :, 0]
        grid, n, wobble = big + wobble * rng.uniform(-0.5, 0.5, big.shape), 2 * n, wobble / decay
    grid = grid[:size, :size] - grid[:size, :size].min()
    return grid / (grid.max() or 1.0)


def _hsv(x: np.ndarray) -> np.ndarray:
    top, low = x.max(2), x.min(2)
    d = top - low
    safe = np.where(d > 0, d, 1)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    h = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    return np.stack([np.where(d > 0, h, 0), np.where(top > 0, d / np.where(top > 0, top, 1), 0), top], 2)


def _rgb(x: np.ndarray) -> np.ndarray:
    h, s, v = x[..., 0] * 6, x[..., 1], x[..., 2]
    k = (np.array([5, 3, 1]) + h[..., None]) % 6
    return v[..., None] - v[..., None] * s[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1)


def corrupt_image(x: np.ndarray, kind: str, strength: float, rng: np.random.Generator) -> np.ndarray:
    """One corruption of an image with values 0 to 255."""
    u = x / 255.0
    h, w = x.shape[:2]
    if kind == "gaussian_noise":
        u = u + rng.normal(size=u.shape) * strength
    elif kind == "shot_noise":
        u = rng.poisson(u * strength) / strength
    elif kind == "speckle_noise":
        u = u + u * rng.normal(size=u.shape) * strength
    elif kind == "impulse_noise":
        hit, salt = rng.uniform(size=u.shape) < strength, rng.uniform(size=u.shape) < 0.5
        u = np.where(hit, salt.astype(float), u)
    elif kind == "gaussian_blur":
        u = _blur(u, gaussian_kernel(strength))
    elif kind == "defocus_blur":
        u = _blur(u, disk_kernel(int(strength)))
    elif kind == "zoom_blur":
        u = (u + sum(clipped_zoom(u, z) for z in np.arange(1, 1 + strength, 0.02))) / (1 + len(np.arange(1, 1 + strength, 0.02)))
    elif kind == "glass_blur":
        u = _blur(u, gaussian_kernel(strength))
        i, j = np.mgrid[:h, :w]
        u = u[np.clip(i + rng.integers(-1, 2, (h, w)), 0, h - 1), np.clip(j + rng.integers(-1, 2, (h, w)), 0, w - 1)]
        u = _blur(u, gaussian_kernel(strength))
    elif kind == "fog":
        top = u.max()
        mist = plasma(1 << (max(h, w) - 1).bit_length(), 2.0, rng)[:h, :w, None]
        u = (u + strength * mist) * top / (top + strength)
    elif kind == "contrast":
        mean = u.mean((0, 1), keepdims=True)
        u = (u - mean) * strength + mean
    elif kind in ("brightness", "saturate"):
        z = _hsv(u)
        z[..., 2 if kind == "brightness" else 1] = np.clip(z[..., 2] + strength if kind == "brightness" else z[..., 1] * strength, 0, 1)
        u = _rgb(z)
    elif kind == "pixelate":
        u = resize(u, max(1, int(h * strength)), max(1, int(w * strength)))
        u = u[np.arange(h) * u.shape[0] // h][:, np.arange(w) * u.shape[1] // w]
    elif kind == "elastic":
        dx, dy = (_blur(rng.uniform(-1, 1, (h, w, 1)), gaussian_kernel(3.0))[..., 0] for _ in range(2))
        dx, dy = (d / np.abs(d).max() * strength for d in (dx, dy))
        i, j = np.mgrid[:h, :w]
        u = u[np.clip(np.rint(i + dy), 0, h - 1).astype(int), np.clip(np.rint(j + dx), 0, w - 1).astype(int)]
    elif kind == "jpeg":
        # the lossy step of the codec: quantised cosine coefficients of 8 x 8 blocks
        n = 8
        k = np.arange(n)
        basis = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
        basis[0] /= np.sqrt(2)
        step = strength * (1 + k[:, None] + k[None]) / 255
        p = np.pad(u, ((0, -h % n), (0, -w % n), (0, 0)), mode="edge")
        blocks = p.reshape(p.shape[0] // n, n, p.shape[1] // n, n, -1).transpose(0, 2, 4, 1, 3)
        c = np.rint((basis @ blocks @ basis.T) / step) * step
        u = (basis.T @ c @ basis).transpose(0, 3, 1, 4, 2).reshape(p.shape)[:h, :w]
    else:
        raise ValueError(f"no corruption {kind}")
    return np.clip(u, 0, 1) * 255.0


CORRUPTIONS = ("gaussian_noise", "shot_noise", "speckle_noise", "impulse_noise", "gaussian_blur", "defocus_blur", "zoom_blur", "glass_blur", "fog", "contrast", "brightness", "saturate", "pixelate", "elastic", "jpeg")


def mask_image(x: np.ndarray, size: tuple[int, int], n_masks: int, kind: str, scale: float, rng: np.random.Generator, clip: tuple[float, float] = (0, 255)) -> np.ndarray:
    """Patches of noise or zeros at random places."""
    out = x.copy()
    for _ in range(n_masks):
        a, b = rng.integers(0, x.shape[0] - size[0] + 1), rng.integers(0, x.shape[1] - size[1] + 1)
        patch = out[a : a + size[0], b : b + size[1]]
        if kind == "zero":
            patch[:] = 0
        else:
            noise = rng.normal(size=patch.shape) if kind == "normal" else rng.uniform(-1, 1, patch.shape)
            patch[:] = np.clip(patch + noise * scale, *clip)
    return out


IMAGE = "struct<height:int,width:int,channels:int,data:array<double>>"


def corrupt(df: DataFrame, kind: str, strength: float, key: str, image: str = "image", seed: int = 0, mask: dict | None = None) -> DataFrame:
    """Replaces ``image`` by a corrupted (or, with ``mask``, patched) one; noise
    depends on the row's key and the seed."""

    @F.pandas_udf(IMAGE)
    def run(images: pd.DataFrame, keys: pd.Series) -> pd.DataFrame:
        out = []
        for h, w, c, data, k in zip(images["height"], images["width"], images["channels"], images["data"], keys):
            x, rng = np.asarray(data, float).reshape(h, w, c), np.random.default_rng([seed, int(k) & 0x7FFFFFFFFFFFFFFF])
            out.append((mask_image(x, rng=rng, **mask) if mask else corrupt_image(x, kind, strength, rng)).ravel())
        return pd.DataFrame({"height": images["height"], "width": images["width"], "channels": images["channels"], "data": out})

    return df.withColumn(image, run(F.col(image), F.xxhash64(key)))
