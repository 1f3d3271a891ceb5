"""Queries of scalar and array functions, and of models behind interfaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import bits as B
from ..functions import models as M
from ..functions import peaks as P
from ..functions import scores as S
from ..operators import predict
from . import carriers as C
from .carriers import table
from .registry import query

#: Peaks with entropy weights, in SQL: wp(molecule_id, adduct, i, mz, w).
WEIGHTED = (
    f"{C.PEAKS}, tot AS (SELECT molecule_id, adduct, sum(intensity) AS t FROM peaks GROUP BY ALL), "
    "ent AS (SELECT molecule_id, adduct, -sum(intensity / t * ln(intensity / t)) AS s FROM peaks JOIN tot USING (molecule_id, adduct) GROUP BY ALL), "
    "wp AS (SELECT molecule_id, adduct, seq, mz, row_number() OVER (PARTITION BY molecule_id, adduct ORDER BY mz, intensity) AS i, CASE WHEN s >= 3 THEN intensity ELSE pow(intensity, 0.25::DOUBLE + 0.25::DOUBLE * s) END AS w FROM peaks JOIN ent USING (molecule_id, adduct))"
)


@query(f"WITH {WEIGHTED} SELECT molecule_id, adduct, round(sum(w), 6) AS w FROM wp GROUP BY ALL")
def f1_entropy_weight(spark, d):
    return C.spectra(spark, d).select("molecule_id", "adduct", F.round(P.total(P.entropy_weight(P.field(F.col("peaks"), "intensity"))), 6).alias("w"))


def _cosine_sql(shift: float) -> str:
    near = "b.mz >= a.mz - 2.0::DOUBLE AND b.mz <= a.mz + 2.0::DOUBLE"
    moved = f" OR (b.mz + {shift}::DOUBLE >= a.mz - 2.0::DOUBLE AND b.mz + {shift}::DOUBLE <= a.mz + 2.0::DOUBLE)" if shift else ""
    return (
        f"WITH {WEIGHTED}, n AS (SELECT molecule_id, adduct, sqrt(sum(w * w)) AS n FROM wp GROUP BY ALL), "
        f"pr AS (SELECT a.molecule_id AS m, a.adduct AS adduct, a.i AS i, b.i AS j, a.w * b.w AS p FROM wp a JOIN wp b ON b.molecule_id = a.molecule_id + 1 AND a.adduct = b.adduct AND (({near}){moved}) WHERE a.molecule_id % 2 = 0), "
        "l AS (SELECT m, adduct, list(struct_pack(ua := [i], ub := [j], s := p) ORDER BY p DESC, i, j) AS ps FROM pr GROUP BY ALL) "
        "SELECT a.molecule_id AS m, a.adduct AS adduct, round(coalesce(list_reduce(ps, lambda x, p: CASE WHEN list_has_any(x.ua, p.ua) OR list_has_any(x.ub, p.ub) THEN x ELSE struct_pack(ua := list_concat(x.ua, p.ua), ub := list_concat(x.ub, p.ub), s := x.s + p.s) END).s, 0) / (a.n * b.n), 6) AS sim "
        "FROM n a JOIN n b ON b.molecule_id = a.molecule_id + 1 AND a.adduct = b.adduct LEFT JOIN l ON l.m = a.molecule_id AND l.adduct = a.adduct WHERE a.molecule_id % 2 = 0"
    )


def _cosines(spark, d, shift):
    s = C.spectra(spark, d).select("molecule_id", "adduct", "peaks")
    a = s.where("molecule_id % 2 = 0").select(F.col("molecule_id").alias("m"), "adduct", F.col("peaks").alias("pa"))
    b = s.where("molecule_id % 2 = 1").select((F.col("molecule_id") - 1).alias("m"), "adduct", F.col("peaks").alias("pb"))
    return a.join(b, ["m", "adduct"]).select("m", "adduct", F.round(P.modified_cosine(F.col("pa"), F.col("pb"), F.lit(shift), 2.0), 6).alias("sim"))


@query(_cosine_sql(0))
def f2_cosine(spark, d):
    return _cosines(spark, d, 0.0)


@query(_cosine_sql(17.5))
def f3_modified_cosine(spark, d):
    return _cosines(spark, d, 17.5)


@query(
    f"""WITH {WEIGHTED}, b AS (SELECT molecule_id, adduct, least(greatest(trunc(mz / 0.5::DOUBLE)::INT, 0), 4200) AS bin, sum(w) AS w
    FROM wp
    GROUP BY ALL)
SELECT molecule_id, adduct, bin::BIGINT AS bin, round(w / sqrt(sum(w * w) OVER (PARTITION BY molecule_id, adduct)), 6) AS w
    FROM b"""
)
def f4_binned_vector(spark, d):
    from ..operators.library import binned

    s = C.spectra(spark, d).withColumn("id", F.struct("molecule_id", "adduct"))
    return binned(s.select("id", "peaks"), "id").select("id.molecule_id", "id.adduct", F.col("bin").cast("long").alias("bin"), F.round("w", 6).alias("w"))


#: Adducts that stand for types of events, in order of their names.
KINDS = ("[M+H]+", "[M+Na]+", "[M-H]-", "[2M+H]+", "[M+2H]2+")
_ADDUCT_VALUES = ", ".join(f"('{a}', {n}, {z}, {s!r}::DOUBLE)" for a, n, z, s in DEFAULT.adducts())
_KIND_CASE = "(['" + "', '".join(KINDS) + "', 'unknown'])[event_id % 6 + 1]"


@query(
    f"""WITH a(adduct, n_mer, charge, shift) AS (VALUES {_ADDUCT_VALUES}),
e AS (SELECT event_id, value, {_KIND_CASE} AS adduct FROM events)
SELECT event_id, round(CASE WHEN (value * charge - shift) / n_mer > 0 THEN (value * charge - shift) / n_mer END, 6) AS mass
    FROM e
    LEFT
    JOIN a USING (adduct)"""
)
def f5_neutral_mass(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value").alias("precursor_mz"), F.get(F.array(*map(F.lit, (*KINDS, "unknown"))), (F.col("event_id") % 6).cast("int")).alias("adduct"))
    return predict.neutral_mass(e).select("event_id", F.round("mass", 6).alias("mass"))


@query(
    f"""WITH {C.POOL} SELECT a.key AS key, round((bit_count(a.w0 & b.w0) + bit_count(a.w1 & b.w1))::DOUBLE / (a.popcount + b.popcount - bit_count(a.w0 & b.w0) - bit_count(a.w1 & b.w1)), 6) AS t
    FROM pooled a
    JOIN pooled b ON b.key = 0"""
)
def f6_tanimoto(spark, d):
    p = C.pool(spark, d)
    anchor = F.broadcast(p.where("key = 0").select(F.col("fp").alias("a_fp"), F.col("popcount").alias("a_pop")))  # one row
    return p.crossJoin(anchor).select("key", F.round(B.tanimoto(F.col("fp"), F.col("a_fp"), F.col("popcount"), F.col("a_pop")), 6).alias("t"))


@query(f"WITH {C.POOL} SELECT key, popcount FROM pooled")
def f7_popcount(spark, d):
    return C.pool(spark, d).select("key", B.popcount(F.col("fp")).alias("popcount"))


_LOGIT = "ln(least(greatest(p, 1e-4::DOUBLE), 1 - 1e-4::DOUBLE)) - ln(1 - least(greatest(p, 1e-4::DOUBLE), 1 - 1e-4::DOUBLE))"
_LIK = f"{C.POOL}, pr AS (SELECT label, i, avg(1 / (1 + exp(-8 * embedding[i + 1]::DOUBLE))) AS p FROM embeddings, range(0, 64) t(i) GROUP BY ALL), bits AS (SELECT key, label, i FROM pooled, range(0, 64) t(i) WHERE (CASE WHEN i < 32 THEN (w0 >> i::INT) & 1 ELSE (w1 >> (i - 32)::INT) & 1 END) = 1)"


def _bit_rows(spark, d, p):
    """(key, label, bit, lik) of set bits with the logit of their probability."""
    pool = C.pool(spark, d)
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("fp", F.floor(i / 32).cast("int")).bitwiseAND(F.pow(F.lit(2.0), i % 32).cast("long")) != 0)
    return pool.select("key", "label", F.explode(on).alias("i")).join(p, ["label", "i"])


def _probs(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", "i").agg(F.avg(S.sigmoid(8 * F.col("x").cast("double"))).alias("p"))


@query(f"WITH {_LIK} SELECT key, round(sum({_LOGIT}), 5) AS score FROM bits JOIN pr USING (label, i) GROUP BY key")
def f8_loglik(spark, d):
    return _bit_rows(spark, d, _probs(spark, d)).groupBy("key").agg(F.round(F.sum(S.logit(F.col("p"))), 5).alias("score"))


@query(
    f"""WITH {_LIK} SELECT key, round(sum(({_LOGIT}) * (1 + i / 100.0::DOUBLE) + 0.1::DOUBLE), 5) AS score
    FROM bits
    JOIN pr USING (label, i)
    GROUP BY key"""
)
def f9_logit_weights(spark, d):
    """Weight and bias by bit come as columns; nothing global is changed."""
    lik = S.logit(F.col("p"), 1e-4, 1 + F.col("i") / 100.0, 0.1)
    return _bit_rows(spark, d, _probs(spark, d)).groupBy("key").agg(F.round(F.sum(lik), 5).alias("score"))


_BLOCKS = f"WITH {_LIK}, f AS (SELECT p.key, p.label, coalesce(sum({_LOGIT}) FILTER (i < 32), 0) AS a, coalesce(sum({_LOGIT}) FILTER (i >= 32 AND i < 48), 0) AS b, coalesce(sum({_LOGIT}) FILTER (i >= 48), 0) AS c FROM pooled p LEFT JOIN bits USING (key, label) LEFT JOIN pr USING (label, i) GROUP BY ALL)"
_Z = lambda c: f"CASE WHEN stddev_pop({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE 0 END"


def _families(spark, d):
    bits = _bit_rows(spark, d, _probs(spark, d)).withColumn("l", S.logit(F.col("p")))
    part = lambda lo, hi: F.coalesce(F.sum(F.when((F.col("i") >= lo) & (F.col("i") < hi), F.col("l"))), F.lit(0.0))
    sums = bits.groupBy("key").agg(part(0, 32).alias("a"), part(32, 48).alias("b"), part(48, 64).alias("c"))
    zero = {"a": 0.0, "b": 0.0, "c": 0.0}
    return C.pool(spark, d).select("key", "label").join(sums, "key", "left").na.fill(zero)


@query(f"{_BLOCKS} SELECT key, round({_Z('a')} + 0.3::DOUBLE * ({_Z('(b + c)')}), 5) AS score FROM f WINDOW w AS (PARTITION BY label)")
def f10_pooled_blocks(spark, d):
    return _families(spark, d).select("key", F.round(S.pooled_blocks(F.col("a"), F.col("b") + F.col("c"), ["label"], 0.3), 5).alias("score"))


@query(f"{_BLOCKS} SELECT key, round({_Z('a')} + 0.1::DOUBLE * ({_Z('b')}) + 0.1::DOUBLE * ({_Z('c')}), 5) AS score FROM f WINDOW w AS (PARTITION BY label)")
def f11_family_blocks(spark, d):
    return _families(spark, d).select("key", F.round(S.family_blocks(F.col("a"), [F.col("b"), F.col("c")], ["label"], 0.2), 5).alias("score"))


_MM = lambda c, k: f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE {k} END"


@query(f"WITH t AS (SELECT o_orderkey, o_custkey AS g, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN 0 ELSE o_totalprice END AS prop, (o_orderkey % 17)::DOUBLE AS lik FROM orders) SELECT o_orderkey, round(0.3::DOUBLE * coalesce({_MM('prop', 'CASE WHEN max(prop) OVER w > 0 THEN 1 ELSE 0 END')}, 0) + 0.7::DOUBLE * (0.05::DOUBLE + 0.95::DOUBLE * ({_MM('lik', '1')})), 6) AS fused FROM t WINDOW w AS (PARTITION BY g)")
def f12_fusion(spark, d):
    c = F.col("o_custkey") % 4
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(c == 0, None).when(c == 1, 0.0).otherwise(F.col("o_totalprice")).alias("prop"), (F.col("o_orderkey") % 17).cast("double").alias("lik"))
    return t.select("o_orderkey", F.round(S.fused(F.col("prop"), F.col("lik"), ["o_custkey"]), 6).alias("fused"))


@query("SELECT event_id, round(pow(value / 400.0::DOUBLE, 2.5::DOUBLE), 6) AS w FROM events")
def f13_exponent(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.pow(F.col("value") / 400.0, 2.5), 6).alias("w"))


_FEATURES = (
    f"WITH {WEIGHTED}, n AS (SELECT molecule_id, adduct, sqrt(sum(w * w)) AS n FROM wp GROUP BY ALL), x AS (SELECT molecule_id, adduct, least(greatest(trunc(mz / 0.2::DOUBLE)::INT, 0), 6000) AS col, w / n AS val FROM wp JOIN n USING (molecule_id, adduct) "
    "UNION ALL SELECT molecule_id, adduct, 6001 + least(greatest(trunc((300.0::DOUBLE - mz) / 0.2::DOUBLE)::INT, 0), 6000), w / n FROM wp JOIN n USING (molecule_id, adduct) WHERE 300.0::DOUBLE - mz > 0 "
    "UNION ALL SELECT molecule_id, adduct, 12002, 0.25 FROM n UNION ALL SELECT molecule_id, adduct, 12003, 1.0 FROM n UNION ALL SELECT molecule_id, adduct, 12004, 0.0 FROM n)"
)


@query(
    f"""{_FEATURES} SELECT molecule_id, adduct, count(*) AS n, round(sum(val), 5) AS total, round(sum(val * (col % 97)), 4) AS mixed
    FROM x
    GROUP BY ALL"""
)
def f14_featurize(spark, d):
    s = C.spectra(spark, d).select("molecule_id", "adduct", P.featurize(F.col("peaks"), F.lit(300.0), F.lit(" Positive ")).alias("f"))
    return s.select("molecule_id", "adduct", F.size("f").cast("long").alias("n"), F.round(F.aggregate("f", F.lit(0.0), lambda a, e: a + e["val"]), 5).alias("total"), F.round(F.aggregate("f", F.lit(0.0), lambda a, e: a + e["val"] * (e["col"] % 97)), 4).alias("mixed"))


@query(f"{_FEATURES} SELECT adduct, col::BIGINT AS col, round(sum(val), 5) AS val FROM x GROUP BY ALL")
def f15_feature_matrix(spark, d):
    """Duplicates of a place are summed."""
    s = C.spectra(spark, d).select("adduct", F.explode(P.featurize(F.col("peaks"), F.lit(300.0), F.lit("positive"))).alias("e"))
    return s.groupBy("adduct", F.col("e.col").cast("long").alias("col")).agg(F.round(F.sum("e.val"), 5).alias("val"))


@query(
    f"""WITH {WEIGHTED}, t AS (SELECT *
    FROM wp
    QUALIFY row_number() OVER (PARTITION BY molecule_id, adduct ORDER BY w DESC, mz) <= 8)
SELECT molecule_id, adduct, count(*) AS n, round(sum(w) / sqrt(sum(w * w)), 6) AS intensity, round(sum(mz), 6) AS mz
    FROM t
    GROUP BY ALL"""
)
def f16_tensor(spark, d):
    s = C.spectra(spark, d).withColumn("t", P.tensor(F.col("peaks"), 8))
    return s.select("molecule_id", "adduct", F.size(F.filter("t.mask", lambda m: m)).cast("long").alias("n"), F.round(P.total(F.col("t.intensity")), 6).alias("intensity"), F.round(P.total(F.col("t.mz")), 6).alias("mz"))


@query(
    """SELECT role, (CASE lower(trim(role)) WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END)::BIGINT AS mode, count(*) AS n
    FROM conversations
    GROUP BY ALL"""
)
def f17_mode_id(spark, d):
    swapped = F.when(F.col("role") == "user", " Positive ").when(F.col("role") == "assistant", "NEGATIVE").otherwise(F.col("role"))
    return table(spark, d, "conversations").groupBy("role", P.mode_id(swapped).cast("long").alias("mode")).agg(F.count("*").alias("n"))


@query(
    """SELECT p_partkey, round(sin(p_retailprice * 2 * pi() / 1000.0::DOUBLE), 5) AS slow_sin,
        round(cos(p_retailprice * 2 * pi() / 1000.0::DOUBLE), 5) AS slow_cos
    FROM part"""
)
def f18_mass_embedding(spark, d):
    e = P.mass_embedding(F.col("p_retailprice"), 8)
    return table(spark, d, "part").select("p_partkey", F.round(F.get(e, F.lit(3)), 5).alias("slow_sin"), F.round(F.get(e, F.lit(7)), 5).alias("slow_cos"))


@query("SELECT vec_id, round(1 / (1 + exp(-embedding[3]::DOUBLE)), 6) AS p FROM embeddings")
def f19_sigmoid(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(S.sigmoid(F.get("embedding", F.lit(2)).cast("double")), 6).alias("p"))


@query(
    """WITH t AS (SELECT vec_id, list_transform(embedding,
        lambda x: 0.5::DOUBLE * (1 / (1 + exp(-8 * x::DOUBLE))) + 0.5::DOUBLE * (CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS p,
        list_transform(embedding, lambda x: CASE WHEN x > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c
    FROM embeddings),
u AS (SELECT vec_id, i, p[i] AS p, c[i] AS c FROM t, range(1, 65) r(i))
SELECT vec_id, round(sum(CASE WHEN p >= 0.5 AND c = 1 THEN 1.0::DOUBLE ELSE 0 END) / sum(CASE
    WHEN p >= 0.5 OR c = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS tanimoto, round(sum(p * c) / (sqrt(sum(p * p)) * sqrt(sum(c * c))), 6) AS cosine
    FROM u
    GROUP BY vec_id"""
)
def f20_interpolated(spark, d):
    """Half the prediction and half the truth, against another truth: Tanimoto at 0.5 and cosine."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    mixed = F.transform("x", lambda x: 0.5 * S.sigmoid(8 * x) + 0.5 * F.when(x > 0, 1.0).otherwise(0.0))
    both = F.zip_with(mixed, F.transform("x", lambda x: F.when(x > F.lit(0.05), 1.0).otherwise(0.0)), lambda p, c: F.struct(p.alias("p"), c.alias("c")))
    fold = lambda f: F.aggregate("b", F.lit(0.0), lambda a, v: a + f(v["p"], v["c"]))
    t = fold(lambda p, c: F.when((p >= 0.5) & (c == 1), 1.0).otherwise(0.0)) / fold(lambda p, c: F.when((p >= 0.5) | (c == 1), 1.0).otherwise(0.0))
    cos = fold(lambda p, c: p * c) / (F.sqrt(fold(lambda p, c: p * p)) * F.sqrt(fold(lambda p, c: c * c)))
    return e.withColumn("b", both).select("vec_id", F.round(t, 6).alias("tanimoto"), F.round(cos, 6).alias("cosine"))


@query(
    """SELECT p_partkey, round(greatest(least(p_retailprice, 950.0::DOUBLE), 910.0::DOUBLE), 4) AS clipped,
        round(ln(p_retailprice), 6) AS ln, round(ln(1 + p_size), 6) AS ln1, round(exp(p_size / 50.0::DOUBLE), 6) AS e,
        round(sqrt(p_size), 6) AS root, abs(p_size - 25)::BIGINT AS off
    FROM part"""
)
def f21_math(spark, d):
    m, s = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(F.greatest(F.least(m, F.lit(950.0)), F.lit(910.0)), 4).alias("clipped"), F.round(F.ln(m), 6).alias("ln"), F.round(F.log1p(s), 6).alias("ln1"), F.round(F.exp(s / 50.0), 6).alias("e"), F.round(F.sqrt(s), 6).alias("root"), F.abs(s - 25).cast("long").alias("off"))


@query(
    f"""WITH {C.POOL}, b AS (SELECT key, i
    FROM pooled, range(0, 64) t(i)
    WHERE (CASE WHEN i < 32 THEN (w0 >> i::INT) & 1 ELSE (w1 >> (i - 32)::INT) & 1 END) = 1)
SELECT key, count(*) FILTER (i < 16) AS first, count(*) FILTER (i >= 16 AND i < 40) AS middle, sum(i)::BIGINT AS places
    FROM b
    GROUP BY key"""
)
def b1_bit_blocks(spark, d):
    """Places of set bits, by blocks; packing and unpacking give them back."""
    p = C.pool(spark, d).withColumn("fp", B.unpack(B.pack(F.col("fp"))))
    n = lambda lo, hi: F.size(B.on_bits(F.col("fp"), lo, hi)).cast("long")
    return p.where("popcount > 0").select("key", n(0, 16).alias("first"), n(16, 40).alias("middle"), F.aggregate(B.on_bits(F.col("fp"), 0, 64), F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))


@query(
    """SELECT page_id, split_part(url, '/', 3) AS host, lower(trim(url)) AS clean, contains(url, 'http') AS has,
        array_to_string(string_split(url, '/'), ';') AS joined, regexp_replace(url, '[0-9]+', '#') AS masked,
        regexp_extract(url, '([0-9]+)', 1) AS digits
    FROM pages"""
)
def b2_strings(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.coalesce(F.get(F.split(u, "/"), F.lit(2)), F.lit("")).alias("host"), F.lower(F.trim(u)).alias("clean"), F.contains(u, F.lit("http")).alias("has"), F.array_join(F.split(u, "/"), ";").alias("joined"), F.regexp_replace(u, "^([^0-9]*)[0-9]+", "$1#").alias("masked"), F.regexp_extract(u, "([0-9]+)", 1).alias("digits"))


@query(
    f"""WITH {C.SPECTRA} SELECT molecule_id, adduct, len(list_concat(peaks, peaks))::BIGINT AS twice,
        len(list_distinct(list_transform(peaks, lambda p: p.intensity)))::BIGINT AS different,
        round(list_max(list_transform(peaks, lambda p: p.mz)), 4) AS top, list_contains(list_transform(peaks,
        lambda p: p.intensity), 0.5::DOUBLE) AS has
    FROM spectra"""
)
def b3_arrays(spark, d):
    s = C.spectra(spark, d)
    own = P.field(F.col("peaks"), "intensity")
    return s.select("molecule_id", "adduct", F.size(F.concat("peaks", "peaks")).cast("long").alias("twice"), F.size(F.array_distinct(own)).cast("long").alias("different"), F.round(F.array_max(P.field(F.col("peaks"), "mz")), 4).alias("top"), F.array_contains(own, F.lit(0.5)).alias("has"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k')::INT < 10")
def b4_json_and_maps(spark, d):
    e = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,int>"))
    return e.select("event_id", F.element_at("m", "k").cast("long").alias("k")).where("k < 10")


# --- models and chemistry behind interfaces ------------------------------------------------------------------------


@query("SELECT DISTINCT p_name AS smiles, upper(split_part(p_name, ' ', 1)) AS ckey FROM part")
def c1_canonical_keys(spark, d):
    """The interface with a stand-in parser; each distinct string goes through it once."""
    return M.canonical_keys(table(spark, d, "part").select(F.col("p_name").alias("smiles")), lambda ss: [s.split(" ")[0].upper() for s in ss])


@query("SELECT p_partkey AS key, length(p_name)::DOUBLE AS exact_mass FROM part WHERE p_size % 9 <> 0")
def c2_fingerprints(spark, d):
    """Rows that don't parse (here: an empty string) go."""
    named = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_name")).alias("smiles"))
    made = M.fingerprints(named, lambda ss: [(s.encode()[:8], float(len(s))) if s else None for s in ss])
    return made.select(F.col("key").cast("long").alias("key"), "exact_mass")


def _weights(seed: int) -> dict:
    """Small whole weights by a rule, so that SQL can state them too."""
    w1 = np.fromfunction(lambda i, j: ((i * 7 + j * 3 + seed) % 5) - 2, (64, 4))
    return {"layers": [(w1, np.zeros(4)), (np.array([[1.0], [-1.0], [0.5], [0.25]]), np.zeros(1))]}


def _forward_sql(seed: int) -> str:
    h = [f"greatest(0, list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * (((i * 7 + {j} * 3 + {seed}) % 5) - 2))))" for j in range(4)]
    return f"1 / (1 + exp(-({h[0]} - {h[1]} + 0.5::DOUBLE * {h[2]} + 0.25::DOUBLE * {h[3]})))"


@query(f"SELECT vec_id, round({_forward_sql(1)}, 6) AS p FROM embeddings")
def c8_mlp_forward(spark, d):
    out = M.predict(table(spark, d, "embeddings"), "vec_id", "embedding", M.Registry().load(_weights(1)))
    return out.select("vec_id", F.round(F.get("p", F.lit(0)), 6).alias("p"))


@query(f"SELECT vec_id, round(({_forward_sql(1)} + {_forward_sql(2)}) / 2, 6) AS p FROM embeddings")
def c9_ensemble(spark, d):
    out = M.predict(table(spark, d, "embeddings"), "vec_id", "embedding", M.Registry().load([_weights(1), _weights(2)]), batch=128)
    return out.select("vec_id", F.round(F.get("p", F.lit(0)), 6).alias("p"))
