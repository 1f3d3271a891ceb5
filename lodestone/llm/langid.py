"""Language identification in two steps: the family first, then the language within it.

Features are runs of two and three UTF-8 bytes, lower-cased, every ASCII byte that is not a letter
being a space; their shares among a text's runs are hashed into a fixed number of bins. The classifier
is linear support vector machines (squared hinge loss): one against the rest for families, one against one
for the languages of a family. A text's score is the share that the calibrated margins give its family,
times that of its language within the family.

Families come from the fixed table below; a language that is not in it is a family of its own. The model
learns from a bounded sample of labelled rows: ``per_lang`` rows at most for each of the ``most_langs`` most
frequent languages, those of least hash of id and text. Each machine is fitted by a task of its own, which gets the
rows of its two sides: of a family's rest, ``MOST_REST`` rows in equal parts of its languages. The driver holds
weights, not rows. Prediction reads every text whole, in blocks of bounded size.

Null texts and texts without a letter get ``und`` with score 0, as do all texts where nothing could be
learned. With one learned language, all others get it with score 1. Rows are kept as they are, repeated ones
too; of other columns, those that are asked for come along, and the names of the two new ones can be given
where they would clash. A row without an id counts as held out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import cut, ship, tidied, working

#: Families of languages by ISO 639-1 code (fixed values).
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "finnic": ("et", "fi"),
    "turkic": ("az", "kk", "tr"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
UNKNOWN = "und"
#: Bins for runs; bytes of text worked on at once.
BINS, BLOCK = 1 << 14, 1 << 19
#: Labelled rows that a language is learned from, at most; languages that are learned, at most.
PER_LANG, MOST_LANGS = 600, 100
#: Rows that stand for all languages outside a family when it is told from them, about.
MOST_REST = 3000


def _letters() -> np.ndarray:
    keep = np.full(256, 32, dtype=np.uint8)
    keep[97:123] = np.arange(97, 123)
    keep[65:91] = np.arange(97, 123)
    keep[128:] = np.arange(128, 256)
    return keep


LETTERS = _letters()


def _bins(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the runs of two and of three bytes that start at each byte; BINS where there is no letter."""
    b = LETTERS[raw].astype(np.uint32)
    two = (b[:-1] * 251 + b[1:]) if len(b) > 1 else np.zeros(0, np.uint32)
    three = (two[:-1] * 251 + b[2:]) if len(b) > 2 else np.zeros(0, np.uint32)
    blank2, blank3 = two == 32 * 251 + 32, three == (32 * 251 + 32) * 251 + 32
    half = BINS // 2
    two = ((two * np.uint32(2654435761)) >> np.uint32(19)) % half
    three = ((three * np.uint32(2246822519)) >> np.uint32(18)) % half + half
    two[blank2] = BINS
    three[blank3] = BINS
    return two.astype(np.int32), three.astype(np.int32)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All lower-cased bytes of a column of strings, and the offsets of its texts (null: empty)."""
    column = pc.utf8_lower(column.cast(pa.large_string())).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """(texts, where each starts, (bins of two, bins of three)) for blocks of bytes; runs stay within texts."""
    for at in range(0, len(raw), BLOCK):
        to = min(at + BLOCK, len(raw))
        part = raw[at : min(to + 2, len(raw))]
        two, three = (runs[: to - at] for runs in _bins(part))
        first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, to, "left")
        ends = offsets[first + 1 : last + 1] - at
        for n, runs in ((1, two), (2, three)):
            for k in range(1, n + 1):
                cut = ends - k
                runs[cut[(cut >= 0) & (cut < len(runs))]] = BINS
        yield np.arange(first, last), np.maximum(offsets[first:last] - at, 0), (two, three)


def _sums(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the sum of table's rows over its runs, and their number."""
    n = len(offsets) - 1
    sums, counts = np.zeros((n, table.shape[1])), np.zeros(n)
    counted = np.ones(BINS + 1, dtype=np.float32)
    counted[BINS] = 0
    weights = np.concatenate([table, counted[:, None]], axis=1).astype(np.float32)
    for rows, starts, runs in _pieces(raw, offsets):
        for one in runs:
            if not len(one):
                continue
            values = weights[one]
            here = (starts < len(one)) & (np.append(starts[1:], len(one)) > starts)
            if here.any():
                got = np.add.reduceat(values, starts[here], axis=0, dtype=np.float64)
                sums[rows[here]] += got[:, :-1]
                counts[rows[here]] += got[:, -1]
    return sums, counts


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bins, shares) of each text of a column."""
    raw, offsets = _texts(column)
    for k in range(len(column)):
        counts = np.zeros(BINS + 1, dtype=np.int64)
        text = raw[offsets[k] : offsets[k + 1]]
        for _, _, runs in _pieces(text, np.array([0, len(text)])):
            for one in runs:
                counts += np.bincount(np.asarray(one, dtype=np.int64), minlength=BINS + 1)
        bins = np.nonzero(counts[:BINS])[0]
        yield bins, counts[bins] / max(counts[:BINS].sum(), 1)


@dataclass
class Model:
    families: list[str]
    langs: dict[str, list[str]]
    #: Bins by machines, then a row of zeros for runs without a letter; the machines' biases and scales.
    weights: np.ndarray
    biases: np.ndarray
    scales: np.ndarray
    #: What the columns of weights tell apart: ("family", f) or (family, one language, another).
    machines: list[tuple[str, ...]]

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores from the machines' margins, a row for each text."""
        n = len(margins)
        sure = 1 / (1 + np.exp(-np.clip(margins * self.scales, -40, 40)))
        of_family = np.ones((n, len(self.families)))
        for k, m in enumerate(self.machines):
            if m[0] == "family":
                of_family[:, self.families.index(m[1])] = sure[:, k]
        best = of_family.argmax(axis=1)
        score = of_family.max(axis=1) / of_family.sum(axis=1).clip(1e-12) if len(self.families) > 1 else np.ones(n)
        names = np.empty(n, dtype=object)
        for f, family in enumerate(self.families):
            rows, langs = np.nonzero(best == f)[0], self.langs[family]
            votes = np.zeros((len(rows), len(langs)))
            for k, m in enumerate(self.machines):
                if m[0] == family and len(m) == 3:
                    a, b = langs.index(m[1]), langs.index(m[2])
                    votes[:, a] += sure[rows, k]
                    votes[:, b] += 1 - sure[rows, k]
            pairs = max(len(langs) - 1, 1)
            chosen = votes.argmax(axis=1)
            names[rows] = np.array(langs, dtype=object)[chosen]
            if len(langs) > 1:
                score[rows] *= votes.max(axis=1) / pairs
        return names, score.clip(0, 1)


def _machine(bins: np.ndarray, shares: np.ndarray, starts: np.ndarray, sign: np.ndarray, steps: int = 150, c: float = 30.0) -> tuple[np.ndarray, float, float]:
    """A linear machine by Nesterov's method on the squared hinge loss, balanced between its two sides."""
    rows = np.repeat(np.arange(len(sign)), np.diff(np.append(starts, len(bins))))
    weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)) * c
    w = v = np.zeros(BINS)
    b = vb = 0.0
    norm = np.bincount(rows, weights=shares**2, minlength=len(sign))
    rate = 1 / (1 + 2 * (weight * (norm + 1)).sum())
    for k in range(steps):
        margin = np.bincount(rows, weights=v[bins] * shares, minlength=len(sign)) + vb
        slack = np.maximum(0, 1 - sign * margin)
        pull = -2 * weight * sign * slack
        nw = v - rate * (v / c * 0.1 + np.bincount(bins, weights=pull[rows] * shares, minlength=BINS))
        nb = vb - rate * pull.sum()
        mix = k / (k + 3)
        v, vb, w, b = nw + mix * (nw - w), nb + mix * (nb - b), nw, nb
    margin = sign * (np.bincount(rows, weights=w[bins] * shares, minlength=len(sign)) + b)
    return w, b, float(4.0 / max(np.median(margin), 0.05))


def fit(sample: DataFrame) -> Model | None:
    """A model from (lang, place, bins, shares): features of labelled texts, numbered within their language; None without any.

    Each machine is a group, and so a task; rows of a language go to the machines that it takes part in.
    """
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())  # MOST_LANGS, or what a caller asked for
    if not langs:
        return None
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    names = sorted(families)
    machines: list[tuple[str, ...]] = [("family", family) for family in names] if len(names) > 1 else []
    machines += [(family, one, other) for family in names for i, one in enumerate(families[family]) for other in families[family][i + 1 :]]
    mirrored = len(names) == 2  # the second family's machine is the first one's mirror image
    sides = []
    for k, m in enumerate(machines):
        if m[0] != "family":
            sides += [(k, m[1], 1.0, None), (k, m[2], -1.0, None)]
        elif not (mirrored and k == 1):
            own = families[m[1]]
            each = -(-MOST_REST // (len(langs) - len(own)))
            sides += [(k, lang, 1.0, None) if lang in own else (k, lang, -1.0, each) for lang in langs]
    got: dict[int, tuple[np.ndarray, float, float]] = {}
    if sides:
        taking = F.broadcast(sample.sparkSession.createDataFrame(sides, "machine int, lang string, sign double, upto long"))
        dealt = sample.join(taking, "lang").where("upto is null or place <= upto").select("machine", "lang", "sign", "bins", "shares")
        fitted = dealt.repartition(len(machines), "machine").groupBy("machine").applyInArrow(_fitted, "machine int, weights binary, bias double, scale double")
        got = {r.machine: (np.frombuffer(r.weights, "<f8"), r.bias, r.scale) for r in fitted.collect()}
    if mirrored:
        w, b, scale = got[0]
        got[1] = -w, -b, scale
    weights = np.zeros((BINS + 1, len(machines)), dtype=np.float32)
    for k in range(len(machines)):
        weights[:BINS, k] = got[k][0] * 100
    return Model(names, families, weights, np.array([got[k][1] for k in range(len(machines))]), np.array([got[k][2] for k in range(len(machines))]), machines)


def _fitted(key: tuple, table: pa.Table) -> pa.Table:
    """One machine from its rows, in an order of their own."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("lang", "bins", "shares", "sign")), strict=True))
    bins, shares = [np.frombuffer(r[1], "<i4") for r in rows], [np.frombuffer(r[2], "<f4") for r in rows]
    starts = np.cumsum([0] + [len(x) for x in bins[:-1]])
    w, b, scale = _machine(np.concatenate(bins).astype(np.int64), np.concatenate(shares).astype(np.float64), starts, np.array([r[3] for r in rows]))
    return pa.table({"machine": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([w.astype("<f8").tobytes()], pa.binary()), "bias": [b], "scale": [scale]})


def learn(labelled: DataFrame, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS) -> Model | None:
    """A model from labelled (doc_id, text, lang): per_lang rows at most of each of most_langs languages."""
    ship(labelled.sparkSession)
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    often = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not often:
        return None
    # A share of the rows by hash, somewhat more than wanted, and of those the first ones: no repeated row can exceed the bound.
    share = F.coalesce(*(F.when(F.col("lang") == r.lang, F.lit(min(1.0, 1.5 * per_lang / r.n))) for r in often), F.lit(0.0))
    hashed = known.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(5)).alias("h"))
    some = hashed.where(F.pmod("h", F.lit(1 << 24)) < share * (1 << 24))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = some.withColumn("place", place.cast("long")).where(F.col("place") <= per_lang).select("lang", "place", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                got = list(features(part.column(2)))
                made = (pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in (([b for b, _ in got], "<i4"), ([s * 100 for _, s in got], "<f4")))
                yield pa.record_batch([part.column(0), part.column(1), *made], ["lang", "place", "bins", "shares"])

    made = sample.mapInArrow(tidied(counted), "lang string, place long, bins binary, shares binary")
    return fit(cut(made.where(F.length("bins") > 0)))


def predict(docs: DataFrame, model: Model | None, keep: list[str | Column] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """For each text of docs: the columns in keep, and the language and its score under the given names."""
    ship(docs.sparkSession)
    # A text that is kept anyway goes to the workers once.
    own = [] if any(isinstance(c, str) and c == "text" for c in keep) else [F.col("text")]
    spoken = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    kept = [F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c for c in keep]
    kept = docs.select(*kept).schema
    chosen = docs.select(*(F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c for c in keep), *own, spoken)
    chosen = chosen.toDF(*(f"c{i}" for i in range(len(chosen.columns))))
    at_text = len(kept) if own else list(keep).index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working()
        for batch in batches:
            # A few hundred texts at a time, so that many long ones never meet.
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                spoken = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                if model is None:
                    langs, scores = np.full(part.num_rows, UNKNOWN, dtype=object), np.zeros(part.num_rows)
                else:
                    sums, counts = _sums(*_texts(part.column(at_text)), model.weights)
                    langs, scores = model.predict(sums / counts.clip(1)[:, None] + model.biases)
                langs[~spoken], scores[~spoken] = UNKNOWN, 0.0
                yield pa.record_batch([*part.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], out)

    schema = StructType([*kept.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    out = schema.names
    return chosen.mapInArrow(tidied(run), schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row must not be learned from; one without an id must not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))
