"""Opaque models and chemistry as interfaces: columns in, columns out.

No chemistry library and no deep-learning runtime is part of this engine. A structure parser, a fingerprinter
or a trained network comes as a Python callable on batches; the relational work around it is here. The
multilayer perceptron below is complete in numpy and takes weights from wherever they were trained.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..sources import checkpoints
from .transformer import PeakTransformer


class Canonicalizer(Protocol):
    def __call__(self, smiles: list[str]) -> list[str | None]: ...


class Fingerprinter(Protocol):
    def __call__(self, smiles: list[str]) -> list[tuple[bytes, float] | None]: ...


class Model(Protocol):
    def __call__(self, features: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class Mlp:
    """Dense layers with batch norm folded in, ReLU between them, and a sigmoid at the end."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]

    def __call__(self, features: np.ndarray) -> np.ndarray:
        x = features
        for k, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if k < len(self.layers) - 1:
                x = np.maximum(x, 0)
        return 1 / (1 + np.exp(-x))


@dataclass(frozen=True)
class Ensemble:
    """The mean of its members' probabilities."""

    members: tuple[Model, ...]

    def __call__(self, features: np.ndarray) -> np.ndarray:
        return np.mean([m(features) for m in self.members], axis=0)


@dataclass
class Registry:
    """Makes a model from a checkpoint by what the checkpoint holds; a list of them makes an ensemble."""

    makers: list[tuple[Callable[[dict], bool], Callable[[dict], Model]]] = field(
        default_factory=lambda: [
            (lambda c: "layers" in c, lambda c: Mlp(tuple((np.asarray(w), np.asarray(b)) for w, b in c["layers"]))),
            (lambda c: "transformer" in c, lambda c: PeakTransformer(c["transformer"], c["heads"])),
        ]
    )

    def load_file(self, spark: SparkSession, path: str | list[str]) -> Model:
        """A model from a checkpoint table, or the ensemble of several, by the kind that it was saved under."""
        if isinstance(path, list):
            return Ensemble(tuple(self.load_file(spark, p) for p in path))
        kind, arrays = checkpoints.load(spark, path)
        if kind == "layers":
            return self.load({"layers": [arrays[name] for name in sorted(arrays, key=int)]})
        heads = arrays.pop("heads", None)
        return self.load({kind: arrays, "heads": None if heads is None else int(heads[0])})

    def load(self, checkpoint: dict | list[dict]) -> Model:
        if isinstance(checkpoint, list):
            return Ensemble(tuple(self.load(c) for c in checkpoint))
        for holds, make in self.makers:
            if holds(checkpoint):
                return make(checkpoint)
        raise ValueError(f"no model is known for a checkpoint with {sorted(checkpoint)}")


def predict(df: DataFrame, id_: str, features: str, model: Model, batch: int = 2048) -> DataFrame:
    """(id, p): a model's output for each row of an array column, in Arrow batches; weights go to each executor once."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                x = np.array(part.column(1).to_pylist(), dtype=np.float64)
                yield pa.record_batch([part.column(0), pa.array(list(sent.value(x)), pa.list_(pa.float64()))], [id_, "p"])

    return df.select(id_, F.col(features).cast("array<double>").alias("x")).mapInArrow(run, f"`{id_}` {dict(df.dtypes)[id_]}, p array<double>")


def predict_peaks(df: DataFrame, id_: str, tensor: str, precursor: str, mode: str, model: PeakTransformer, batch: int = 512, max_mz: float = 1500.0) -> DataFrame:
    """(id, p) of a model over padded peaks: tensor is peaks.tensor's struct, mode peaks.mode_id's number."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                mz, own, mask = (np.array(part.column(k).to_pylist()) for k in (1, 2, 3))
                ion, kind = part.column(4).to_numpy(zero_copy_only=False), part.column(5).to_numpy(zero_copy_only=False)
                p = sent.value(mz, own, mask, ion, kind)
                yield pa.record_batch([part.column(0), pa.array(list(p), pa.list_(pa.float64()))], [id_, "p"])

    ion = F.least(F.col(precursor).cast("double"), F.lit(max_mz))
    flat = df.select(id_, f"{tensor}.mz", f"{tensor}.intensity", f"{tensor}.mask", ion.alias("ion"), F.col(mode).cast("int").alias("kind"))
    return flat.mapInArrow(run, f"`{id_}` {dict(df.dtypes)[id_]}, p array<double>")


class StructureParser(Protocol):
    """Canonical structure, key, mass, elements and fingerprint of each; None where it can't be parsed."""

    def __call__(self, smiles: list[str]) -> list[tuple[str, str, float, list[str], bytes] | None]: ...


def pool_rows(raw: DataFrame, parse: StructureParser, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(id, key, smiles, exact_mass, fingerprint) of raw lines (id, smiles) that a pool takes.

    Of several fragments the longest counts. Rows that don't parse, have an element that the configuration lacks
    or a mass outside its range (both ends belong to it) are left out; none stops the others.
    """
    size = F.transform(F.split("smiles", r"\."), lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))
    longest = F.aggregate(size, F.struct(F.lit(-1).alias("n"), F.lit("").alias("s")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))["s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = parse(rows.column(1).to_pylist())
            keep = [i for i, m in enumerate(made) if m is not None]
            columns = [pa.array([made[i][k] for i in keep], t) for k, t in ((1, pa.string()), (0, pa.string()), (2, pa.float64()), (3, pa.list_(pa.string())), (4, pa.binary()))]
            yield pa.record_batch([rows.column(0).take(pa.array(keep, pa.int64())), *columns], ["id", "key", "smiles", "exact_mass", "elements", "fingerprint"])

    parsed = raw.where("smiles is not null").select(F.col("id").cast("string").alias("id"), longest.alias("smiles")).mapInArrow(run, "id string, key string, smiles string, exact_mass double, elements array<string>, fingerprint binary")
    known = F.size(F.array_except("elements", F.array(*map(F.lit, cfg.elements)))) == 0
    return parsed.where(known & F.col("exact_mass").between(*cfg.pool_mass)).drop("elements")


class Descriptors(Protocol):
    """Named numbers and pattern matches of each structure; None where it can't be parsed."""

    def __call__(self, smiles: list[str]) -> list[dict[str, float] | None]: ...


def described(structures: DataFrame, describe: Descriptors, names: list[str]) -> DataFrame:
    """(key, names ...) of the structures that parse; filters over them are plain column expressions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = describe(rows.column(1).to_pylist())
            keep = [i for i, m in enumerate(made) if m is not None]
            yield pa.record_batch([rows.column(0).take(pa.array(keep, pa.int64())), *(pa.array([float(made[i][n]) for i in keep], pa.float64()) for n in names)], ["key", *names])

    return structures.select("key", "smiles").mapInArrow(run, ", ".join([f"key {dict(structures.dtypes)['key']}", *(f"`{n}` double" for n in names)]))


def canonical_keys(smiles: DataFrame, canonicalize: Canonicalizer) -> DataFrame:
    """(smiles, ckey) of distinct strings: each is parsed once, then joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.record_batch([rows.column(0), pa.array(canonicalize(rows.column(0).to_pylist()), pa.string())], ["smiles", "ckey"])

    return smiles.select("smiles").where("smiles is not null").distinct().mapInArrow(run, "smiles string, ckey string")


def fingerprints(structures: DataFrame, fingerprint: Fingerprinter, chunk: int = 500) -> DataFrame:
    """(key, smiles, fingerprint, exact_mass) of structures that parse; the callable sees chunk of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                rows = batch.slice(at, chunk)
                made = fingerprint(rows.column(1).to_pylist())
                keep = pa.array([m is not None for m in made])
                packed, masses = pa.array([m[0] for m in made if m], pa.binary()), pa.array([m[1] for m in made if m], pa.float64())
                yield pa.record_batch([rows.column(0).filter(keep), rows.column(1).filter(keep), packed, masses], ["key", "smiles", "fingerprint", "exact_mass"])

    return structures.select("key", "smiles").mapInArrow(run, "key string, smiles string, fingerprint binary, exact_mass double")


def fit_bit_weights(lists: DataFrame, bits: int, steps: int = 200, rate: float = 0.05, tau: float = 10.0, pull: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weight and bias of each bit's logit, by a listwise softmax of a truth over its decoys.

    lists: a row for each truth with truth array<tinyint>, decoys array<array<tinyint>> (of bounded number; a row without
    any, or with a null, tells nothing and is left out) and logits array<double>, all of ``bits`` places. Starts at, and is pulled to, (1, 0), where it
    stays without rows. Every step is a pass over all rows, which should be stored: tasks sum their gradients, sums
    are summed by bit, and 2 * bits numbers reach the driver, whatever the number of rows and tasks.
    """
    known = lists.where("truth is not null and logits is not null and size(decoys) > 0").select("truth", "decoys", "logits")
    n, w, b = known.count(), np.ones(bits), np.zeros(bits)
    for _ in range(steps if n else 0):
        parts = known.mapInArrow(_gradients(w.copy(), b.copy(), tau), "bit int, of_weight double, of_bias double")
        sums = np.zeros((2, bits))
        for r in parts.groupBy("bit").agg(F.sum("of_weight").alias("w"), F.sum("of_bias").alias("b")).collect():
            sums[:, r.bit] = r.w, r.b
        w -= rate * (sums[0] / n + 2 * pull * (w - 1))
        b -= rate * (sums[1] / n + 2 * pull * b)
    return w, b


def _gradients(w: np.ndarray, b: np.ndarray, tau: float, rows: int = 256):
    """A function for mapInArrow: a task's sums of the gradients by weight and by bias, a row for each bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_weight, of_bias = np.zeros(len(w)), np.zeros(len(w))
        flat = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(w))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                truths, decoys, logits = batch.slice(at, rows).columns
                t, d, z = flat(truths), flat(decoys.flatten()), flat(logits)
                counts = decoys.value_lengths().to_numpy(zero_copy_only=False)
                begins, whose = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
                adjusted = z * w + b
                true, other = (t * adjusted).sum(axis=1) / tau, (d * adjusted[whose]).sum(axis=1) / tau
                most = np.maximum(true, np.maximum.reduceat(other, begins))
                true, other = np.exp(true - most), np.exp(other - most[whose])
                total = true + np.add.reduceat(other, begins)
                pulled = (true / total - 1)[:, None] * t + np.add.reduceat((other / total[whose])[:, None] * d, begins, axis=0)
                of_weight += (pulled * z).sum(axis=0) / tau
                of_bias += pulled.sum(axis=0) / tau
        yield pa.record_batch([pa.array(np.arange(len(w)), pa.int32()), pa.array(of_weight), pa.array(of_bias)], ["bit", "of_weight", "of_bias"])

    return run
