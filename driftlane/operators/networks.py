"""Small networks in numpy: layers with their gradients, an optimiser, and what the
detectors train with them. All are fitted on bounded samples and go with the tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


class Adam:
    """Steps along gradients; another class of the same two methods may take its place."""

    def __init__(self, params: list[np.ndarray], rate: float = 3e-3):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = ([np.zeros_like(p) for p in params] for _ in range(2))

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def train(params: list[np.ndarray], loss: Callable, n: int, epochs: int = 60, batch: int = 256, rate: float = 3e-3, seed: int = 0, optimiser: Callable = Adam) -> list[float]:
    """``loss(rows, rng)`` gives a batch's mean loss and the gradients of ``params``,
    which change in place. Returns the mean loss of each epoch."""
    rng, steps, out = np.random.default_rng(seed), optimiser(params, rate), []
    for _ in range(epochs):
        order, losses = rng.permutation(n), []
        for a in range(0, n, batch):
            value, grads = loss(order[a : a + batch], rng)
            steps.step(grads)
            losses.append(value)
        out.append(float(np.mean(losses)))
    return out


@dataclass
class Network:
    """A multilayer perceptron with tanh inside: weights and biases."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    @staticmethod
    def make(sizes: list[int], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        return Network([rng.normal(size=(a, b)) / np.sqrt(a) for a, b in zip(sizes, sizes[1:])], [np.zeros(b) for b in sizes[1:]])

    @property
    def params(self) -> list[np.ndarray]:
        return [p for pair in zip(self.weights, self.biases) for p in pair]

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            x = x @ w + b
            x = x if i == len(self.weights) - 1 else np.tanh(x)
            out.append(x)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.layers(x)[-1]

    def back(self, gradient: np.ndarray, outs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients of all parameters, and of the input, from that of the output."""
        grads: list[np.ndarray] = []
        for i in reversed(range(len(self.weights))):
            if i < len(self.weights) - 1:
                gradient = gradient * (1 - outs[i + 1] ** 2)
            grads = [outs[i].T @ gradient, gradient.sum(0), *grads]
            gradient = gradient @ self.weights[i].T
        return grads, gradient

    def fit(self, x: np.ndarray, y: np.ndarray, loss_gradient: Callable, epochs: int = 60, batch: int = 256, rate: float = 3e-3, seed: int = 0, optimiser: Callable = Adam) -> Network:
        """Descends ``loss_gradient(output, target)``, a gradient per row."""

        def loss(at: np.ndarray, _) -> tuple[float, list[np.ndarray]]:
            outs = self.layers(x[at])
            g = loss_gradient(outs[-1], y[at])
            return float((g**2).sum(1).mean()), self.back(g / len(at), outs)[0]

        train(self.params, loss, len(x), epochs, batch, rate, seed, optimiser)
        return self


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def row_noise(x: np.ndarray, samples: int, width: int, seed: int = 0) -> np.ndarray:
    """(row, sample, width) normal numbers that a row's values and the seed determine,
    so a score doesn't depend on the batch that a row comes in."""
    draw = lambda r: np.random.default_rng([seed, zlib.crc32(np.ascontiguousarray(r).tobytes())]).normal(size=(samples, width))
    return np.stack([draw(r) for r in x]) if len(x) else np.zeros((0, samples, width))


@dataclass
class Autoencoder:
    """Codes and reconstructions of rows that are standardised by ``mean`` and ``dev``.

    With ``sigma`` it is variational: the encoder gives the mean and the log variance
    of a code, the loss is minus the evidence bound, |x - y|^2 / (2 sigma^2) + beta
    KL(code | standard normal), and codes are drawn. Else the loss is |x - y|^2.
    """

    mean: np.ndarray
    dev: np.ndarray
    encoder: Network
    decoder: Network
    sigma: float | None = None
    beta: float = 1.0
    losses: list[float] = field(default_factory=list)

    @staticmethod
    def make(x: np.ndarray, hidden: int, latent: int, sigma: float | None = None, beta: float = 1.0, seed: int = 0) -> Autoencoder:
        d = x.shape[1]
        encoder, decoder = Network.make([d, hidden, latent * (2 if sigma else 1)], seed), Network.make([latent, hidden, d], seed + 1)
        return Autoencoder(x.mean(0), x.std(0) + 1e-9, encoder, decoder, sigma, beta)

    @property
    def latent(self) -> int:
        return len(self.decoder.weights[0])

    @property
    def params(self) -> list[np.ndarray]:
        return self.encoder.params + self.decoder.params

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.dev

    def draw(self, z: np.ndarray, noise: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Outputs of the encoder's layers for scaled rows, and codes."""
        outs = self.encoder.layers(z)
        code = outs[-1]
        return outs, code[:, : self.latent] + np.exp(code[:, self.latent :] / 2) * noise if self.sigma else code

    def loss(self, z: np.ndarray, rng: np.random.Generator, more: Callable | None = None) -> tuple[float, list[np.ndarray]]:
        """Mean loss of scaled rows and gradients; ``more(z, code, y)`` may add a loss
        with its gradients of the code and of the reconstruction."""
        noise = rng.normal(size=(len(z), self.latent))
        outs, code = self.draw(z, noise)
        back = self.decoder.layers(code)
        gap, n = back[-1] - z, len(z)
        weight = 1 / (2 * self.sigma**2) if self.sigma else 1.0
        value, g_code, g_y = weight * (gap**2).sum(1).mean(), 0.0, 2 * weight * gap / n
        if more:
            extra, to_code, to_y = more(z, code, back[-1])
            value, g_code, g_y = value + extra, g_code + to_code, g_y + to_y
        d_grads, through = self.decoder.back(g_y, back)
        g_code = g_code + through
        if self.sigma:
            mu, lv = outs[-1][:, : self.latent], outs[-1][:, self.latent :]
            value += self.beta * 0.5 * (np.exp(lv) + mu**2 - 1 - lv).sum(1).mean()
            to_mu, to_lv = g_code + self.beta * mu / n, g_code * noise * 0.5 * np.exp(lv / 2) + self.beta * 0.5 * (np.exp(lv) - 1) / n
            g_code = np.concatenate([to_mu, to_lv], axis=1)
        return float(value), self.encoder.back(g_code, outs)[0] + d_grads

    def fit(self, x: np.ndarray, epochs: int = 60, seed: int = 0, **kw) -> Autoencoder:
        z = self.scaled(x)
        self.losses = train(self.params, lambda at, rng: self.loss(z[at], rng), len(z), epochs, seed=seed, **kw)
        return self

    def reconstructions(self, x: np.ndarray, samples: int = 1, seed: int = 0) -> np.ndarray:
        """(row, sample, feature) on the scale of the rows."""
        noise = row_noise(x, samples, self.latent, seed) if self.sigma else np.zeros((len(x), samples, self.latent))
        return np.stack([self.decoder(self.draw(self.scaled(x), noise[:, s])[1]) * self.dev + self.mean for s in range(samples)], 1)


def describe(x: np.ndarray, code: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A row's code, 1 - cosine and relative distance (up to 100) of its reconstruction."""
    length = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    cos = (x * y).sum(1) / np.maximum(length[0] * length[1], 1e-12)
    rel = np.minimum(np.linalg.norm(x - y, axis=1) / (np.minimum(*length) + 1e-12), 100.0)
    return np.column_stack([code, 1 - cos, rel])


def mixture_of(z: np.ndarray, gamma: np.ndarray, eps: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances that memberships give."""
    n = gamma.sum(0) + 1e-9
    means = gamma.T @ z / n[:, None]
    gaps = z[:, None] - means[None]
    covs = np.einsum("nk,nki,nkj->kij", gamma, gaps, gaps) / n[:, None, None] + eps * np.eye(z.shape[1])
    return n / n.sum(), means, covs


@dataclass
class DensityAutoencoder:
    """An autoencoder and a mixture over what describes its rows, trained together.

    A gate network gives the memberships of a batch, these the mixture; the loss adds
    ``w_energy`` times the mean energy (minus log density) and ``w_cov`` times the
    inverse diagonals of the covariances to that of the autoencoder. What describes a
    row is ``recon_features(row, code, reconstruction)``, its code first. The gate descends
    the cross entropy with the posterior memberships. Gradients take the batch's
    mixture, and the two features of the reconstruction, as constants.
    """

    auto: Autoencoder
    gate: Network
    w_energy: float = 0.1
    w_cov: float = 0.005
    recon_features: Callable = describe
    mixture: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    losses: list[float] = field(default_factory=list)

    def fit(self, x: np.ndarray, epochs: int = 60, seed: int = 0, **kw) -> DensityAutoencoder:
        from driftlane.operators.mixture import gaussian_energy

        z, gate_grads, k = self.auto.scaled(x), [], len(self.gate.biases[-1])

        def density(rows: np.ndarray, code: np.ndarray, y: np.ndarray):
            f, n = self.recon_features(rows, code, y), len(rows)
            outs = self.gate.layers(f)
            gamma = softmax(outs[-1])
            weights, means, covs = mixture_of(f, gamma)
            logs = np.stack([-gaussian_energy(f, weights[i : i + 1], means[i : i + 1], covs[i : i + 1]) for i in range(k)], 1)
            top = logs.max(1, keepdims=True)
            post = np.exp(logs - top)
            energy = -(top[:, 0] + np.log(post.sum(1)))
            post /= post.sum(1, keepdims=True)
            gate_grads[:] = self.gate.back((gamma - post) / n, outs)[0]
            gaps, diag = f[:, None] - means[None], np.einsum("kii->ki", covs)
            pull = np.einsum("nk,kij,nkj->ni", post, np.linalg.inv(covs), gaps) * self.w_energy / n
            push = (gamma[:, :, None] * 2 * gaps / (gamma.sum(0)[None, :, None] + 1e-9) / diag[None] ** 2).sum(1) * self.w_cov
            to_code = (pull - push)[:, : self.auto.latent]
            return self.w_energy * energy.mean() + self.w_cov * (1 / diag).sum(), to_code, np.zeros_like(y)

        def loss(at: np.ndarray, rng: np.random.Generator):
            value, grads = self.auto.loss(z[at], rng, density)
            return value, grads + list(gate_grads)

        self.losses = train(self.auto.params + self.gate.params, loss, len(z), epochs, seed=seed, **kw)
        f = self.features(x, row_noise(x, 1, self.auto.latent, seed)[:, 0])
        self.mixture = mixture_of(f, softmax(self.gate(f)))
        return self

    def features(self, x: np.ndarray, noise: np.ndarray) -> np.ndarray:
        z = self.auto.scaled(x)
        code = self.auto.draw(z, noise)[1]
        return self.recon_features(z, code, self.auto.decoder(code))

    def energy(self, x: np.ndarray, samples: int = 1, seed: int = 0) -> np.ndarray:
        """Mean energy over drawn codes (one is enough without them)."""
        from driftlane.operators.mixture import gaussian_energy

        noise = row_noise(x, samples, self.auto.latent, seed) if self.auto.sigma else np.zeros((len(x), 1, self.auto.latent))
        return np.mean([gaussian_energy(self.features(x, noise[:, s]), *self.mixture) for s in range(noise.shape[1])], axis=0)


# -- classifiers and what defends them ------------------------------------------


def sharpened(p: np.ndarray, temperature: float) -> np.ndarray:
    q = p ** (1 / temperature)
    return q / q.sum(1, keepdims=True)


def classifier(x: np.ndarray, labels: np.ndarray, hidden: int = 16, epochs: int = 60, seed: int = 0, **kw) -> Network:
    """A network of logits by cross entropy."""
    net = Network.make([x.shape[1], hidden, int(labels.max()) + 1], seed)
    target = np.eye(int(labels.max()) + 1)[labels]
    return net.fit(x, target, lambda o, y: softmax(o) - y, epochs, seed=seed, **kw)


def defender(x: np.ndarray, model: Network, hidden: int = 16, latent: int = 4, w_model: float = 1.0, w_recon: float = 0.0, temperature: float = 1.0, epochs: int = 60, seed: int = 0, **kw) -> Autoencoder:
    """An autoencoder whose reconstructions the model takes for the rows themselves:
    the loss is ``w_model`` KL(model(x), sharpened | model(y)) + ``w_recon`` |x - y|^2.
    The model stays as it is."""
    auto = Autoencoder.make(x, hidden, latent, seed=seed)
    z, want = auto.scaled(x), sharpened(softmax(model(x)), temperature)

    def loss(at: np.ndarray, _) -> tuple[float, list[np.ndarray]]:
        outs = auto.encoder.layers(z[at])
        back = auto.decoder.layers(outs[-1])
        seen = model.layers(back[-1] * auto.dev + auto.mean)
        q, p, gap = softmax(seen[-1]), want[at], back[-1] - z[at]
        value = w_model * (p * (np.log(np.maximum(p, 1e-12)) - np.log(np.maximum(q, 1e-12)))).sum(1).mean() + w_recon * (gap**2).sum(1).mean()
        to_y = model.back(w_model * (q - p) / len(at), seen)[1] * auto.dev + 2 * w_recon * gap / len(at)
        d_grads, to_code = auto.decoder.back(to_y, back)
        return float(value), auto.encoder.back(to_code, outs)[0] + d_grads

    auto.losses = train(auto.params, loss, len(x), epochs, seed=seed, **kw)
    return auto


def distilled(x: np.ndarray, model: Network, hidden: int = 8, temperature: float = 1.0, epochs: int = 60, seed: int = 0, **kw) -> Network:
    """A smaller network that gives the model's probabilities, sharpened."""
    want = sharpened(softmax(model(x)), temperature)
    student = Network.make([x.shape[1], hidden, want.shape[1]], seed)
    return student.fit(x, want, lambda o, y: softmax(o) - y, epochs, seed=seed, **kw)


# -- sequences -------------------------------------------------------------------


@dataclass
class Recurrent:
    """A recurrent network over windows of one value: after each value it gives the
    next one, and an estimate of its own squared error there."""

    w_in: np.ndarray
    w_state: np.ndarray
    bias: np.ndarray
    w_out: np.ndarray
    b_out: np.ndarray
    losses: list[float] = field(default_factory=list)

    @staticmethod
    def make(hidden: int = 16, seed: int = 0) -> Recurrent:
        rng = np.random.default_rng(seed)
        return Recurrent(rng.normal(size=(1, hidden)), rng.normal(size=(hidden, hidden)) * 0.5 / np.sqrt(hidden), np.zeros(hidden), rng.normal(size=(hidden, 2)) / np.sqrt(hidden), np.array([0.0, 1.0]))

    @property
    def params(self) -> list[np.ndarray]:
        return [self.w_in, self.w_state, self.bias, self.w_out, self.b_out]

    def states(self, x: np.ndarray) -> np.ndarray:
        """(window, step, hidden)."""
        h, out = np.zeros((len(x), len(self.bias))), []
        for t in range(x.shape[1]):
            h = np.tanh(x[:, t : t + 1] @ self.w_in + h @ self.w_state + self.bias)
            out.append(h)
        return np.stack(out, 1)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next values and estimated squared errors of each step."""
        out = self.states(x) @ self.w_out + self.b_out
        return out[..., 0], np.maximum(out[..., 1], 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, seed: int = 0, **kw) -> Recurrent:
        """Squared errors of the next values, and of their estimates, back through time.
        Null targets (NaN) don't count."""

        def loss(at: np.ndarray, _) -> tuple[float, list[np.ndarray]]:
            a, h = x[at], self.states(x[at])
            out, on = h @ self.w_out + self.b_out, ~np.isnan(y[at])
            gap = np.where(on, out[..., 0] - np.nan_to_num(y[at]), 0.0)
            miss = np.where(on, out[..., 1] - gap**2, 0.0)
            n = max(1, int(on.sum()))
            g = np.stack([2 * gap, 0.02 * miss], -1) / n  # the estimates follow slowly
            g_out, g_b = np.einsum("nth,ntk->hk", h, g), g.sum((0, 1))
            to_h, g_in, g_state, g_bias = g @ self.w_out.T, np.zeros_like(self.w_in), np.zeros_like(self.w_state), np.zeros_like(self.bias)
            later = np.zeros((len(a), len(self.bias)))
            for t in reversed(range(a.shape[1])):
                d = (to_h[:, t] + later) * (1 - h[:, t] ** 2)
                g_in += a[:, t : t + 1].T @ d
                g_bias += d.sum(0)
                if t:
                    g_state += h[:, t - 1].T @ d
                later = d @ self.w_state.T
            return float((gap**2).sum() / n), [g_in, g_state, g_bias, g_out, g_b]

        self.losses = train(self.params, loss, len(x), epochs, seed=seed, **kw)
        return self
