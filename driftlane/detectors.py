"""Detectors: the operators with a reference, parameters and a ``predict``.

A detector never changes: ``predict`` gives a report or a scored table, and
``updated`` a new detector whose reference has taken in new rows. Frames stay
lazy where the operator is.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.operators import adversarial, kernels, learned, mixture, neighbours, networks, projection, recon, thresholds, timeseries, univariate
from driftlane.streaming import online


class NotFitted(Exception):
    """A detector was asked before it had a reference."""


class NoThreshold(Exception):
    """Outliers were asked for before a threshold was inferred."""


def _same(df: DataFrame) -> DataFrame:
    return df


# -- drift per feature ---------------------------------------------------------


@dataclass(frozen=True)
class UnivariateDrift:
    """``update`` is None, {"last": n} or {"reservoir": n}; ``key`` names the columns
    that order or identify rows for it. ``preprocess`` maps a DataFrame to one; with
    ``preprocess_at_init`` the reference given is raw and is mapped once."""

    ref: DataFrame
    features: tuple[str, ...]
    p_val: float = 0.05
    correction: str = "bonferroni"
    preprocess: Callable[[DataFrame], DataFrame] = _same
    preprocess_at_init: bool = True
    update: Mapping[str, int] | None = None
    key: tuple[str, ...] = ()
    seed: int = 0
    n: int | None = None  # rows seen so far

    def _tests(self, pair: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _reference(self) -> DataFrame:
        return self.preprocess(self.ref)

    def score(self, df: DataFrame) -> DataFrame:
        return self._tests(univariate.pair(self._reference(), self.preprocess(df), self.features))

    def predict(self, df: DataFrame, drift_type: str = "batch") -> DataFrame:
        """``feature``: a row per feature, at the level ``p_val``. ``batch``: one row,
        drift if any feature passes the corrected level."""
        report = self.score(df)
        return univariate.feature_decision(report, self.p_val) if drift_type == "feature" else univariate.batch_decision(report, self.p_val, self.correction)

    def updated(self, df: DataFrame):
        """To be called after ``predict``: the reference takes in the rows."""
        rows = self.ref.unionByName(df.select(*self.ref.columns))
        if self.update is None:
            return self
        (kind, n), seen = next(iter(self.update.items())), (self.n or self.ref.count()) + df.count()
        if kind == "last":
            return replace(self, ref=univariate.last_rows(rows, n, self.key[0]), n=seen)
        return replace(self, ref=univariate.reservoir(rows, n, self.seed, self.key), n=seen)


@dataclass(frozen=True)
class KSDrift(UnivariateDrift):
    alternative: str = "two-sided"

    def _tests(self, pair):
        return univariate.ks(pair, self.features, self.alternative)


@dataclass(frozen=True)
class CVMDrift(UnivariateDrift):
    def _tests(self, pair):
        return univariate.cvm(pair, self.features)


@dataclass(frozen=True)
class FETDrift(UnivariateDrift):
    alternative: str = "greater"

    def _tests(self, pair):
        return univariate.fet_statistic(pair, self.features, self.alternative)


@dataclass(frozen=True)
class ChiSquareDrift(UnivariateDrift):
    def _tests(self, pair):
        return univariate.chi2(pair, self.features)


@dataclass(frozen=True)
class TabularDrift(UnivariateDrift):
    """``categories``: categorical features with their values, their number, or None
    to take them from the data. Values that neither sample has add nothing."""

    categories: Mapping[str, object] = field(default_factory=dict)
    alternative: str = "two-sided"

    def _tests(self, pair):
        return univariate.tabular(pair, [f for f in self.features if f not in self.categories], list(self.categories), self.alternative)


# -- drift by kernels and models ------------------------------------------------


@dataclass(frozen=True)
class MMDDrift:
    ref: DataFrame
    vec_col: str = "features"
    id_col: str = "id"
    p_val: float = 0.05
    kernel: Callable | None = None
    sigma: tuple[float, ...] | None = None
    n_permutations: int = 100
    seed: int = 0
    init_sigma: Callable | None = None

    def predict(self, df: DataFrame) -> dict:
        kernel = self.kernel or (kernels.GaussianRBF(self.sigma) if self.sigma else None)
        return kernels.mmd(self.ref, df, kernel, self.p_val, self.n_permutations, self.vec_col, self.id_col, self.seed, self.init_sigma)


@dataclass(frozen=True)
class LSDDDrift:
    ref: DataFrame
    vec_col: str = "features"
    id_col: str = "id"
    p_val: float = 0.05
    n_permutations: int = 100
    n_kernel_centers: int | None = None
    lambda_rd_max: float = 0.2
    ddof: int = 1
    seed: int = 0

    def predict(self, df: DataFrame) -> dict:
        return kernels.lsdd(self.ref, df, self.p_val, self.n_permutations, self.n_kernel_centers, self.lambda_rd_max, self.vec_col, self.id_col, self.seed, self.ddof)


@dataclass(frozen=True)
class ContextMMDDrift:
    ref: DataFrame
    vec_col: str = "features"
    context_col: str = "context"
    segment: str | None = None
    p_val: float = 0.05
    n_permutations: int = 1000
    seed: int = 0

    def predict(self, df: DataFrame) -> DataFrame:
        cols = [self.vec_col, self.context_col, *([self.segment] if self.segment else [])]
        return learned.context_mmd_drift(univariate.pair(self.ref, df, cols), self.vec_col, self.context_col, self.segment, self.p_val, self.n_permutations, self.seed)


@dataclass(frozen=True)
class LearnedKernelDrift:
    ref: DataFrame
    vec_col: str = "features"
    id_col: str = "id"
    p_val: float = 0.05
    n_permutations: int = 100
    train_size: float = 0.75
    seed: int = 0

    def predict(self, df: DataFrame) -> dict:
        return learned.learned_kernel_drift(self.ref, df, self.vec_col, self.id_col, self.p_val, self.n_permutations, self.train_size, seed=self.seed)


@dataclass(frozen=True)
class ClassifierDrift:
    """``model``: lr, rf, gbt, svc, or an estimator over ``__v`` and ``__y``."""

    ref: DataFrame
    features: list[str] | str
    key: str
    model: object = "lr"
    p_val: float = 0.05
    binarize_preds: bool = False
    n_folds: int | None = 5
    seed: int = 0
    calibrate: bool = False
    use_oob: bool = False

    def predict(self, df: DataFrame) -> DataFrame:
        return learned.classifier_drift(self.ref, df, self.features, self.key, self.model, self.p_val, self.binarize_preds, self.n_folds, self.seed, self.calibrate, self.use_oob)


@dataclass(frozen=True)
class SpotTheDiffDrift:
    ref: DataFrame
    vec_col: str = "features"
    id_col: str = "id"
    p_val: float = 0.05
    n_diffs: int = 1
    seed: int = 0

    def predict(self, df: DataFrame) -> dict:
        return learned.spot_the_diff_drift(self.ref, df, self.vec_col, self.id_col, self.p_val, self.n_diffs, seed=self.seed)


@dataclass(frozen=True)
class ClassifierUncertaintyDrift:
    ref: DataFrame
    probs: str = "probs"
    p_val: float = 0.05
    uncertainty_type: str = "entropy"
    margin_width: float = 0.1
    logits: bool = False

    def predict(self, df: DataFrame) -> DataFrame:
        pair = univariate.pair(self.ref, df, [self.probs])
        return univariate.batch_decision(learned.classifier_uncertainty_drift(pair, self.probs, self.uncertainty_type, self.margin_width, self.logits), self.p_val)


@dataclass(frozen=True)
class RegressorUncertaintyDrift:
    ref: DataFrame
    evaluations: str = "evaluations"
    p_val: float = 0.05

    def predict(self, df: DataFrame) -> DataFrame:
        return univariate.batch_decision(learned.regressor_uncertainty_drift(univariate.pair(self.ref, df, [self.evaluations]), self.evaluations), self.p_val)


CVMDriftOnline, FETDriftOnline, MMDDriftOnline, LSDDDriftOnline = online.CVMOnline, online.FETOnline, online.MMDOnline, online.LSDDOnline


# -- outliers ------------------------------------------------------------------


@dataclass(frozen=True)
class OutlierDetector:
    """``fit`` takes the reference, ``infer_threshold`` a validation table, and
    ``predict`` adds ``score``, ``threshold``, ``is_outlier`` and ``p_value``."""

    features: list[str] | str = "features"
    id_col: str = "id"
    ref: DataFrame | None = None
    threshold: float | None = None
    validation: DataFrame | None = None
    seed: int = 0

    def fit(self, ref: DataFrame):
        return replace(self, ref=ref)

    def _score(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def score(self, df: DataFrame) -> DataFrame:
        if self.ref is None:
            raise NotFitted(type(self).__name__)
        return self._score(df)

    def infer_threshold(self, df: DataFrame, fpr: float):
        if not 0 < fpr < 1:
            raise ValueError("fpr must lie between 0 and 1")
        scores = self.score(df).select("score")
        row = thresholds.higher_threshold(scores, "score", fpr).first()
        if row is None:
            raise ValueError("fpr must be 1 / rows at least")
        return replace(self, threshold=float(row.threshold), validation=scores)

    def predict(self, df: DataFrame) -> DataFrame:
        """Outliers lie strictly above the threshold; p-values are (1 + validation
        scores above) / N. Without a threshold both are null."""
        out = self.score(df)
        if self.threshold is None:
            return out.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("threshold", "double"), ("is_outlier", "int"), ("p_value", "double"))])
        return thresholds.flag_outliers(thresholds.empirical_p_value(out, self.validation, "score"), "score", self.threshold)

    def outliers(self, df: DataFrame) -> DataFrame:
        if self.threshold is None:
            raise NoThreshold(type(self).__name__)
        return self.predict(df).where("is_outlier = 1")


def _vectors(df: DataFrame, d: OutlierDetector) -> DataFrame:
    return df.select(F.col(d.id_col), projection.vector(d.features).alias("__v"))


@dataclass(frozen=True)
class KNN(OutlierDetector):
    """Several ``k`` make an ensemble of z-scored distances that ``aggregator`` joins."""

    k: int | tuple[int, ...] = 5
    kernel: Callable | None = None
    aggregator: str = "average"

    def _score(self, df):
        k = list(self.k) if isinstance(self.k, tuple) else self.k
        out = neighbours.knn_scores(_vectors(df, self), _vectors(self.ref, self), k, self.id_col, "__v", self.kernel)
        if isinstance(k, list):
            own = neighbours.knn_scores(_vectors(self.ref, self), _vectors(self.ref, self), [x + 1 for x in k], self.id_col, "__v", self.kernel)
            out = out.withColumn("score", thresholds.AGGREGATORS[self.aggregator](thresholds.shift_scale_normaliser(own, "scores")("scores")))
        return df.join(out.select(self.id_col, "score"), self.id_col)


@dataclass(frozen=True)
class LOF(OutlierDetector):
    k: int = 5
    kernel: Callable | None = None

    def _score(self, df):
        return df.join(neighbours.lof_scores(_vectors(df, self), _vectors(self.ref, self), self.k, self.id_col, "__v", self.kernel), self.id_col)


@dataclass(frozen=True)
class Mahalanobis(OutlierDetector):
    min_eigenvalue: float = 1e-6

    def _score(self, df):
        return projection.mahalanobis(df, self.ref, self.features, self.min_eigenvalue)


@dataclass(frozen=True)
class PCA(OutlierDetector):
    n_components: int = 1
    kernel: Callable | None = None

    def _score(self, df):
        if self.kernel is None:
            return projection.pca(df, self.ref, self.features, self.n_components)
        return projection.kernel_pca(df, self.ref, self.features, self.n_components, self.kernel, id_col=self.id_col, seed=self.seed)


@dataclass(frozen=True)
class GMM(OutlierDetector):
    n_components: int = 2

    def _score(self, df):
        return mixture.gmm(df, self.ref, self.features, self.n_components, self.seed)


@dataclass(frozen=True)
class SVM(OutlierDetector):
    nu: float = 0.1
    n_components: int = 50
    kernel: Callable | None = None

    def _score(self, df):
        return mixture.svm(df, self.ref, self.features, self.nu, self.n_components, self.kernel, self.id_col, seed=self.seed)


@dataclass(frozen=True)
class IForest(OutlierDetector):
    n_estimators: int = 100
    max_samples: int = 256

    def _score(self, df):
        return mixture.isolation_forest(df, self.ref, self.features, self.n_estimators, self.max_samples, self.id_col, self.seed)


@dataclass(frozen=True)
class OutlierAE(OutlierDetector):
    hidden: int = 16
    latent: int = 2
    percent: float = 100.0
    epochs: int = 60

    def _score(self, df):
        return recon.outlier_ae(df, self.ref, self.features, self.hidden, self.latent, self.percent, self.id_col, epochs=self.epochs, seed=self.seed)


@dataclass(frozen=True)
class OutlierVAE(OutlierAE):
    samples: int = 10
    sigma: float = 0.5
    beta: float = 1.0

    def _score(self, df):
        return recon.outlier_vae(df, self.ref, self.features, self.hidden, self.latent, self.percent, self.id_col, self.samples, self.sigma, self.beta, self.epochs, self.seed)


@dataclass(frozen=True)
class OutlierAEGMM(OutlierDetector):
    n_gmm: int = 2
    hidden: int = 16
    latent: int = 2
    samples: int = 1
    sigma: float | None = None
    w_energy: float = 0.1
    w_cov: float = 0.005
    epochs: int = 60

    def _score(self, df):
        return recon.outlier_aegmm(df, self.ref, self.features, self.n_gmm, self.hidden, self.latent, self.id_col, self.samples, self.sigma, w_energy=self.w_energy, w_cov=self.w_cov, epochs=self.epochs, seed=self.seed)


@dataclass(frozen=True)
class OutlierVAEGMM(OutlierAEGMM):
    samples: int = 10
    sigma: float | None = 0.5


@dataclass(frozen=True)
class SpectralResidual:
    threshold: float | None = None
    window_amp: int = 20
    window_local: int = 20
    n_est_points: int = 10
    n_grad_points: int = 5

    def score(self, df: DataFrame, value: str, order: str, series: str | None = None) -> DataFrame:
        return timeseries.spectral_residual(df, value, order, series, self.window_amp, self.window_local, self.n_est_points, self.n_grad_points)

    def infer_threshold(self, df: DataFrame, value: str, order: str, percent: float = 95.0, series: str | None = None) -> SpectralResidual:
        got = thresholds.percentile_threshold(self.score(df, value, order, series), "score", percent).first()
        return replace(self, threshold=got.threshold)

    def predict(self, df: DataFrame, value: str, order: str, series: str | None = None) -> DataFrame:
        if self.threshold is None:
            raise NoThreshold("SpectralResidual")
        return thresholds.flag_outliers(self.score(df, value, order, series), "score", self.threshold)


@dataclass(frozen=True)
class OutlierSeq2Seq:
    """Squared errors of a recurrent network's next values less its own estimates of
    them and a threshold; an outlier is above 0. ``ref`` has the series to learn from."""

    length: int = 20
    hidden: int = 16
    epochs: int = 40
    threshold: float = 0.0
    seed: int = 0
    ref: DataFrame | None = None

    def fit(self, ref: DataFrame) -> OutlierSeq2Seq:
        return replace(self, ref=ref)

    def score(self, df: DataFrame, value: str, order: str, series: str) -> DataFrame:
        out = timeseries.sequence_errors(df, value, order, series, self.length, self.hidden, self.ref, self.epochs, seed=self.seed)
        return out.withColumn("score", recon.sequence_score("error", "estimate", self.threshold))

    def infer_threshold(self, df: DataFrame, value: str, order: str, series: str, percent: float = 95.0) -> OutlierSeq2Seq:
        got = thresholds.percentile_threshold(self.score(df, value, order, series), "score", percent).first()
        return replace(self, threshold=self.threshold + got.threshold)

    def predict(self, df: DataFrame, value: str, order: str, series: str) -> DataFrame:
        return self.score(df, value, order, series).withColumn("is_outlier", (F.col("score") > 0).cast("int"))


@dataclass(frozen=True)
class OutlierProphet:
    train: DataFrame | None = None
    interval: float = 0.8
    growth: str = "linear"

    def fit(self, df: DataFrame) -> OutlierProphet:
        return replace(self, train=df)

    def predict(self, df: DataFrame, series: str = "series") -> DataFrame:
        if self.train is None:
            raise NotFitted("OutlierProphet")
        return timeseries.seasonal_forecast(self.train, df, series, growth=self.growth, interval=self.interval)


@dataclass(frozen=True)
class LLR:
    """Likelihood ratio of texts by character pairs; the background model may be of
    mutated text."""

    semantic: DataFrame | None = None
    background: DataFrame | None = None
    threshold: float | None = None

    def fit(self, df: DataFrame, background: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", mutation_rate: float = 0.1, mutate_fn: Callable = recon.mutated, seed: int = 0) -> LLR:
        """Without a background table it is the rows themselves, mutated."""
        background = mutate_fn(df, id_col, text_col, mutation_rate, seed=seed) if background is None else background
        return LLR(*[recon.bigram_model(recon.pair_counts(d, text_col)) for d in (df, background)])

    def score(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        if self.semantic is None:
            raise NotFitted("LLR")
        return recon.likelihood_ratio(df, self.semantic, self.background, id_col, text_col)

    def infer_threshold(self, df: DataFrame, percent: float = 95.0, id_col: str = "doc_id", text_col: str = "text") -> LLR:
        got = thresholds.percentile_threshold(self.score(df, id_col, text_col), "score", percent).first()
        return replace(self, threshold=got.threshold)

    def predict(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        if self.threshold is None:
            raise NoThreshold("LLR")
        return thresholds.flag_outliers(self.score(df, id_col, text_col), "score", self.threshold)


# -- adversarial instances -----------------------------------------------------


@dataclass(frozen=True)
class AdversarialAE:
    """Compares a model's class probabilities on a row (``probs``) and on its
    reconstruction (``recon_probs``).

    With ``model`` (a network of logits) and ``ref`` the reconstruction comes from an
    autoencoder that is trained for it; without, both columns are given."""

    ref: DataFrame | None = None
    model: networks.Network | None = None
    features: list[str] | str = "features"
    probs: str = "probs"
    recon_probs: str = "recon_probs"
    temperature: float = 1.0
    hidden: int = 16
    latent: int = 4
    epochs: int = 60
    threshold: float | None = None
    id_col: str = "id"
    seed: int = 0

    def fit(self, ref: DataFrame, model: networks.Network):
        return replace(self, ref=ref, model=model)

    def score(self, df: DataFrame) -> DataFrame:
        if self.model is not None:
            return adversarial.adversarial_ae(df, self.ref, self.features, self.model, self.hidden, self.latent, self.temperature, id_col=self.id_col, epochs=self.epochs, seed=self.seed)
        return df.withColumn("score", adversarial.adversarial_score(self.probs, self.recon_probs, self.temperature))

    def infer_threshold(self, df: DataFrame, percent: float = 99.0, margin: float = 0.0):
        return replace(self, threshold=adversarial.threshold_with_margin(self.score(df), "score", percent, margin).first().threshold)

    def predict(self, df: DataFrame) -> DataFrame:
        if self.threshold is None:
            raise NoThreshold(type(self).__name__)
        out = self.score(df)
        return out.withColumn("is_adversarial", (F.col("score") > self.threshold).cast("int"))

    def correct(self, df: DataFrame) -> DataFrame:
        """Adds the classes without and with defence, and the corrected one."""
        if self.threshold is None:
            raise NoThreshold(type(self).__name__)
        return adversarial.correct(self.score(df), "score", self.threshold, self.probs, self.recon_probs)


@dataclass(frozen=True)
class ModelDistillation(AdversarialAE):
    """Compares a model (``probs``) and a distilled one (``recon_probs``), which is
    trained if ``model`` and ``ref`` are given."""

    loss_type: str = "kld"

    def score(self, df: DataFrame) -> DataFrame:
        if self.model is not None:
            return adversarial.model_distillation(df, self.ref, self.features, self.model, self.hidden, self.temperature, self.loss_type, self.id_col, self.epochs, self.seed)
        return df.withColumn("score", adversarial.distillation_score(self.probs, self.recon_probs, self.loss_type, self.temperature))


MahalanobisOnline = online.MahalanobisOnline


#: What a spec may name, with the parameters it may set.
KNOWN: dict[str, set[str]] = {
    c.__name__: {f for f in c.__dataclass_fields__ if f not in ("ref", "train", "validation", "kernel", "preprocess", "semantic", "background", "model", "init_sigma")}
    for c in (KSDrift, CVMDrift, FETDrift, ChiSquareDrift, TabularDrift, MMDDrift, LSDDDrift, ContextMMDDrift, LearnedKernelDrift, ClassifierDrift, SpotTheDiffDrift, ClassifierUncertaintyDrift, RegressorUncertaintyDrift, KNN, LOF, Mahalanobis, PCA, GMM, SVM, IForest, OutlierAE, OutlierVAE, OutlierAEGMM, OutlierVAEGMM, SpectralResidual, OutlierSeq2Seq, OutlierProphet, AdversarialAE, ModelDistillation, LLR)
}


def from_spec(spec, ref: DataFrame | None, **tables: DataFrame):
    """The detector that a checked spec describes, on its reference and on further
    tables that its fields name, as the two models of ``LLR``."""
    made = globals()[spec.check(KNOWN).detector]
    params = {k: tuple(v) if isinstance(v, list) and (k == "k" or issubclass(made, UnivariateDrift)) else v for k, v in spec.params.items()}
    if "ref" in made.__dataclass_fields__:
        params["ref"] = ref
    elif "train" in made.__dataclass_fields__:
        params["train"] = ref
    return made(**params, **tables)


__all__ = [*KNOWN, "CVMDriftOnline", "FETDriftOnline", "MMDDriftOnline", "LSDDDriftOnline", "MahalanobisOnline", "NotFitted", "NoThreshold", "from_spec"]
