"""The forward pass of an encoder over peaks, in numpy: weights come from wherever they were trained.

Each peak is a token of its mass, of its loss against the precursor (both as sines and cosines) and of its intensity; a
token of the precursor and mode and a class token stand before them. Layers are attention and a feed-forward part, each
behind a normalisation and added to what came in; padded peaks are seen by nobody. The class token gives the bits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def mass_rates(dims: int, shortest: float = 0.001, longest: float = 2000.0) -> np.ndarray:
    """Angular rates, evenly spaced on a logarithmic scale from the longest wavelength to the shortest."""
    return np.exp(np.linspace(math.log(2 * math.pi / longest), math.log(2 * math.pi / shortest), dims // 2))


def embedded(x: np.ndarray, rates: np.ndarray) -> np.ndarray:
    angles = x[..., None] * rates
    return np.concatenate([np.sin(angles), np.cos(angles)], axis=-1)


def _erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def normalised(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    mean, var = x.mean(axis=-1, keepdims=True), x.var(axis=-1, keepdims=True)
    return (x - mean) / np.sqrt(var + 1e-5) * scale + shift


@dataclass(frozen=True)
class PeakTransformer:
    """weights: pairs (w, b) or vectors by name; layers are numbered in names such as ``0.query``."""

    weights: dict
    heads: int

    def _dense(self, name: str, x: np.ndarray) -> np.ndarray:
        w, b = self.weights[name]
        return x @ w + b

    def _attention(self, layer: int, x: np.ndarray, seen: np.ndarray) -> np.ndarray:
        batch, n, dims = x.shape
        split = lambda y: y.reshape(batch, n, self.heads, dims // self.heads).transpose(0, 2, 1, 3)
        q, k, v = (split(self._dense(f"{layer}.{part}", x)) for part in ("query", "key", "value"))
        scores = q @ k.transpose(0, 1, 3, 2) / math.sqrt(dims // self.heads)
        scores = np.where(seen[:, None, None, :], scores, -np.inf)
        shares = np.exp(scores - scores.max(axis=-1, keepdims=True))
        shares /= shares.sum(axis=-1, keepdims=True)
        return self._dense(f"{layer}.out", (shares @ v).transpose(0, 2, 1, 3).reshape(batch, n, dims))

    def __call__(self, mz: np.ndarray, intensity: np.ndarray, mask: np.ndarray, precursor: np.ndarray, mode: np.ndarray) -> np.ndarray:
        """Bit probabilities, a row for each spectrum."""
        w = self.weights
        dims = len(w["class"])
        rates = mass_rates(dims)
        loss = np.maximum(precursor[:, None] - mz, 0)
        own = np.concatenate([embedded(mz, rates), embedded(loss, rates), self._dense("intensity", intensity[..., None])], axis=-1)
        peaks = self._dense("peak", own)
        ion = self._dense("precursor", embedded(precursor, rates)) + w["mode"][mode]
        first = np.broadcast_to(w["class"], (len(mz), dims))
        x = np.concatenate([first[:, None], ion[:, None], peaks], axis=1)
        seen = np.concatenate([np.ones((len(mz), 2), dtype=bool), mask], axis=1)
        for layer in range(sum(1 for name in w if name.endswith(".query"))):
            x = x + self._attention(layer, normalised(x, *w[f"{layer}.norm1"]), seen)
            inner = np.maximum(self._dense(f"{layer}.up", normalised(x, *w[f"{layer}.norm2"])), 0)
            x = x + self._dense(f"{layer}.down", inner)
        top = gelu(self._dense("head1", normalised(x[:, 0], *w["norm"])))
        return 1 / (1 + np.exp(-self._dense("head2", top)))


def shapes(dims: int, layers: int, bits: int) -> dict[str, tuple]:
    """The shape of each weight, without biases; three modes."""
    found: dict[str, tuple] = {"class": (dims,), "mode": (3, dims), "intensity": (1, dims), "peak": (3 * dims, dims), "precursor": (dims, dims)}
    for k in range(layers):
        found |= {f"{k}.{n}": (dims, dims) for n in ("query", "key", "value", "out")}
        found |= {f"{k}.up": (dims, 4 * dims), f"{k}.down": (4 * dims, dims), f"{k}.norm1": (dims,), f"{k}.norm2": (dims,)}
    return found | {"norm": (dims,), "head1": (dims, 2 * dims), "head2": (2 * dims, bits)}


def random_weights(dims: int, layers: int, bits: int, seed: int = 0) -> dict:
    """Weights of a model that nobody has trained, for tests."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in shapes(dims, layers, bits).items():
        if name in ("class", "mode"):
            out[name] = rng.normal(size=shape) * 0.1
        elif "norm" in name:
            out[name] = (1 + rng.normal(size=shape) * 0.1, rng.normal(size=shape) * 0.1)
        else:
            out[name] = (rng.normal(size=shape) / math.sqrt(shape[0]), rng.normal(size=shape[1]) * 0.1)
    return out
