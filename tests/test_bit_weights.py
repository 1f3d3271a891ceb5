"""The fit of bit weights by summed gradients against the same descent over dense arrays, and the lists it is given."""

import random

import numpy as np
import pytest

from lodestone.functions import models
from lodestone.operators.diagnostics import decoy_lists

BITS = 6
LISTS = "truth array<tinyint>, decoys array<array<tinyint>>, logits array<double>"


def dense_fit(rows, steps, rate=0.05, tau=10.0, pull=1e-3):
    """One list after the other, the softmax written out."""
    w, b = np.ones(BITS), np.zeros(BITS)
    for _ in range(steps):
        gw, gb = np.zeros(BITS), np.zeros(BITS)
        for truth, decoys, logits in rows:
            x, z = np.array([truth, *decoys], float), np.array(logits)
            p = np.exp(x @ (z * w + b) / tau)
            p /= p.sum()
            p[0] -= 1
            gw += (p @ x) * z / tau
            gb += (p @ x) / tau
        w = w - rate * (gw / len(rows) + 2 * pull * (w - 1))
        b = b - rate * (gb / len(rows) + 2 * pull * b)
    return w, b


@pytest.mark.parametrize("parts", [1, 7])
def test_fit_against_dense_arrays(spark, parts):
    rng = random.Random(parts)
    bit = lambda: [rng.randint(0, 1) for _ in range(BITS)]
    rows = [(bit(), [bit() for _ in range(rng.randint(1, 5))], [rng.gauss(0, 8) for _ in range(BITS)]) for _ in range(600)]
    nothing = [(None, [bit()], [0.0] * BITS), (bit(), [], [1.0] * BITS), (bit(), None, [1.0] * BITS), (bit(), [bit()], None)]
    lists = spark.createDataFrame([*rows, *nothing], LISTS).repartition(parts)
    w, b = models.fit_bit_weights(lists, BITS, steps=12)
    want_w, want_b = dense_fit(rows, 12)
    assert np.allclose(w, want_w, atol=1e-9) and np.allclose(b, want_b, atol=1e-9)
    assert np.abs(w - 1).max() > 1e-3


def test_fit_without_rows(spark):
    w, b = models.fit_bit_weights(spark.createDataFrame([], LISTS), BITS, steps=3)
    assert (w == 1).all() and (b == 0).all()


def test_decoys_are_others_of_the_label(spark):
    rows = [(i, f"l{i % 3}" if i % 7 else None, [i]) for i in range(1500)] + [(5000, "lone", [5000])]
    got = decoy_lists(spark.createDataFrame(rows, "key long, label string, bits array<int>"), 8, 64).collect()
    label = {k: lab for k, lab, _ in rows}
    assert len(got) == len(rows) == len({r.key for r in got})
    for r in got:
        keys = [x[0] for x in r.decoys]
        assert r.key not in keys and len(keys) == len(set(keys)) and all(label[k] == label[r.key] for k in keys)
        assert len(keys) == (0 if r.key == 5000 else 8)
