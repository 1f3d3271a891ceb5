"""Queries of aggregations and of functions over partitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import peaks as P
from ..functions import scores as S
from ..operators import clusters as K
from ..operators import evaluate as E
from ..operators import nearest as N
from ..operators import ranking as R
from . import carriers as C
from .carriers import table
from .registry import query


@query("SELECT o_custkey AS id, count(*) AS n, min(o_orderkey) AS first, list_sum(list(o_orderkey))::BIGINT AS keys FROM orders GROUP BY 1")
def a1_group_rows(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("rows"))
    return g.select("id", F.size("rows").cast("long").alias("n"), F.array_min("rows").alias("first"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"))


@query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL")
def a2_nested_groups(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(
    f"WITH RECURSIVE {C.PEAKS}, o AS (SELECT *, row_number() OVER (PARTITION BY molecule_id, adduct ORDER BY mz, intensity) AS i FROM peaks), "
    "w AS (SELECT molecule_id, adduct, i, mz, intensity, mz AS anchor, 1 AS c FROM o WHERE i = 1 UNION ALL SELECT o.molecule_id, o.adduct, o.i, o.mz, o.intensity, CASE WHEN o.mz - w.anchor <= 2.0 THEN w.anchor ELSE o.mz END, CASE WHEN o.mz - w.anchor <= 2.0 THEN w.c ELSE w.c + 1 END FROM w JOIN o ON o.molecule_id = w.molecule_id AND o.adduct = w.adduct AND o.i = w.i + 1), "
    "k AS (SELECT molecule_id, adduct, c, sum(mz * intensity) / sum(intensity) AS mz, sum(round(100 * intensity)) AS s FROM w GROUP BY ALL) "
    "SELECT molecule_id, adduct, count(*) AS clusters, round(sum(mz) + 0.00000123457::DOUBLE, 5) AS mz, round(sum(s) / max(s), 5) AS intensity FROM k GROUP BY ALL"
)
def a3_merge_anchored(spark, d):
    """Intensities are summed as whole hundredths and divided once, and masses moved off the ties of rounding: last bits decide nothing."""
    hundredths = F.transform("peaks", lambda p: F.struct(p["mz"].alias("mz"), F.round(100 * p["intensity"]).alias("intensity")))
    s = C.spectra(spark, d).withColumn("m", P.merge_anchored(hundredths, 2.0, scaled=False)).withColumn("s", P.field(F.col("m"), "intensity"))
    total = F.round(P.total(F.col("s")) / F.array_max("s"), 5)
    return s.select("molecule_id", "adduct", F.size("m").cast("long").alias("clusters"), F.round(P.total(P.field(F.col("m"), "mz")) + 0.00000123457, 5).alias("mz"), total.alias("intensity"))


@query(
    f"WITH RECURSIVE {C.PEAKS}, o AS (SELECT *, row_number() OVER (PARTITION BY adduct ORDER BY mz, seq) AS i FROM peaks), "
    "w AS (SELECT adduct, i, mz, mz AS anchor FROM o WHERE i = 1 UNION ALL SELECT o.adduct, o.i, o.mz, CASE WHEN o.mz - w.anchor <= 2.0 THEN w.anchor ELSE o.mz END FROM w JOIN o ON o.adduct = w.adduct AND o.i = w.i + 1) "
    "SELECT adduct, anchor, count(*) AS n, max(mz) AS last FROM w GROUP BY ALL"
)
def a3_segmented(spark, d):
    """Runs in groups of any size: a few adducts have all peaks, which are dealt over ranges of mass."""
    runs = K.anchored(C.peaks(spark, d).select("adduct", "mz"), ["adduct"], "mz", 2.0)
    return runs.groupBy("adduct", "anchor").agg(F.count("*").alias("n"), F.max("mz").alias("last"))


@query(
    """SELECT o_custkey, o_orderstatus, o_orderkey
    FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) = 1"""
)
def a4_dedup_best(spark, d):
    return R.keep_best(table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).drop("o_totalprice")


@query("SELECT p_name, min(p_partkey) AS first FROM part GROUP BY p_name")
def a5_dedup_first(spark, d):
    return R.keep_best(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name"], [F.col("p_partkey")]).withColumnRenamed("p_partkey", "first")


@query(
    """SELECT user_id, max(value) AS score, arg_max(event_type, struct_pack(v := value, s := -event_id)) AS kind
    FROM events
    WHERE value > 0
    GROUP BY user_id"""
)
def a6_max_pool(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("value").alias("score"), F.col("event_type").alias("kind"), "event_id")
    return R.max_pool(e, ["user_id"], "score", "kind", "event_id")


@query(
    f"""WITH {C.POOL}, t AS (SELECT a.key AS key, pow((b.key % 10 + 1) / 10.0::DOUBLE, 2.5::DOUBLE) * (bit_count(a.w0 & b.w0) + bit_count(a.w1 & b.w1))::DOUBLE / (a.popcount + b.popcount - bit_count(a.w0 & b.w0) - bit_count(a.w1 & b.w1)) AS s
    FROM pooled a
    JOIN pooled b ON a.label = b.label)
SELECT key, round(max(s), 6) AS prop FROM t GROUP BY key"""
)
def a7_max_over_anchors(spark, d):
    """Blocks of rows against blocks of anchors; bounds leave few pairs to compare."""
    p = C.pool(spark, d).select("key", "label", "fp", "popcount")
    anchors = p.select("label", F.pow((F.col("key") % 10 + 1) / 10.0, 2.5).alias("weight"), F.col("fp").alias("a_fp"), F.col("popcount").alias("a_pop"))
    # A label without a positive value has no row in the SQL's join either: every label has its own rows as anchors.
    return N.weighted_best(p, anchors, ["label"], "prop").select("key", F.round("prop", 6).alias("prop"))


@query(
    """SELECT p_name AS key, count(*) AS n, arg_min(p_partkey, struct_pack(m := p_retailprice, k := p_partkey)) AS payload
    FROM part
    WHERE p_type = (SELECT min(p_type)
    FROM part) GROUP BY 1
    ORDER BY n DESC, key LIMIT 25"""
)
def a8_frequent(spark, d):
    from ..operators.library import frequent

    p = table(spark, d, "part").select(F.col("p_name").alias("key"), F.col("p_type").alias("mode"), F.col("p_partkey").alias("spec_id"), F.col("p_partkey").alias("smiles"), F.col("p_retailprice").alias("precursor_mz"))
    first = p.agg(F.min("mode").alias("m")).first()
    return frequent(p, first.m, 25).select("key", "n", F.col("smiles").alias("payload"))


@query(
    f"""WITH {C.PEAKS}, t AS (SELECT molecule_id, adduct, intensity / sum(intensity) OVER (PARTITION BY molecule_id, adduct) AS p
    FROM peaks)
SELECT molecule_id, adduct, round(-sum(p * ln(p)), 6) AS entropy FROM t GROUP BY ALL"""
)
def a9_segment_entropy(spark, d):
    return C.spectra(spark, d).select("molecule_id", "adduct", F.round(P.entropy(P.field(F.col("peaks"), "intensity")), 6).alias("entropy"))


@query(
    f"""WITH {C.PEAKS} SELECT molecule_id, adduct, least(greatest(trunc(mz / 0.5)::INT, 0), 900)::BIGINT AS bin,
        round(sum(intensity), 6) AS w
    FROM peaks
    GROUP BY ALL"""
)
def a10_scatter_add(spark, d):
    return C.peaks(spark, d).groupBy("molecule_id", "adduct", P.bin_of(F.col("mz"), 0.5, 901).cast("long").alias("bin")).agg(F.round(F.sum("intensity"), 6).alias("w"))


@query(
    """SELECT vec_id, round(CASE WHEN n > 0 THEN v / n ELSE 0 END, 6) AS first
    FROM (SELECT vec_id, embedding[1]::DOUBLE AS v,
        sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n
    FROM embeddings)"""
)
def a11_unit_length(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = F.coalesce(F.nullif(P.norm(F.col("v")), F.lit(0.0)), F.lit(1.0))
    return e.select("vec_id", F.round(F.get("v", F.lit(0)) / n, 6).alias("first"))


@query(
    """SELECT label::BIGINT AS label, i::BIGINT AS bit, round(avg(1 / (1 + exp(-embedding[i + 1]::DOUBLE))), 6) AS p
    FROM embeddings, range(0, 64) t(i)
    GROUP BY ALL"""
)
def a12_mean_vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("bit", "x"))
    return e.groupBy("label", F.col("bit").cast("long").alias("bit")).agg(F.round(F.avg(S.sigmoid(F.col("x").cast("double"))), 6).alias("p"))


_RANKS = "pred AS (SELECT user_id AS molecule_id, event_type AS ckey, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS rank FROM events GROUP BY user_id, event_type), ans AS (SELECT c_custkey AS molecule_id, (['click', 'view', 'error', 'purchase', 'none'])[c_custkey % 5 + 1] AS ckey FROM customer)"


def _ranked(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("molecule_id"), F.col("event_type").alias("ckey")).agg(F.min("event_id").alias("m"))
    pred = R.top_k(e, ["molecule_id"], [F.col("m")], 25)
    names = F.array(*(F.lit(x) for x in ("click", "view", "error", "purchase", "none")))
    ans = table(spark, d, "customer").select(F.col("c_custkey").alias("molecule_id"), F.get(names, (F.col("c_custkey") % 5).cast("int")).alias("ckey"))
    return ans, pred


@query(
    f"""WITH {_RANKS}, rr AS (SELECT a.molecule_id, coalesce(1.0::DOUBLE / min(p.rank), 0) AS rr
    FROM ans a
    LEFT
    JOIN pred p ON a.molecule_id = p.molecule_id AND a.ckey = p.ckey AND p.rank <= 3
    GROUP BY 1)
SELECT round(avg(rr), 6) AS mrr, count(*) AS n FROM rr"""
)
def a13_mrr(spark, d):
    ans, pred = _ranked(spark, d)
    return E.mrr(ans, pred, 3).select(F.round("mrr", 6).alias("mrr"), "n")


@query(
    """WITH p AS (SELECT source, avg(quality) AS s, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT round(sum(s * n) / sum(n), 6) AS weighted FROM p"""
)
def a14_weighted_mean(spark, d):
    p = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("quality").alias("s"), F.count("*").alias("n"))
    return E.weighted(p, "s", "n").select(F.round("weighted", 6).alias("weighted"))


_PAIRED = "s AS (SELECT l_orderkey AS m, l_linestatus AS config, avg(l_discount) AS rr FROM lineitem GROUP BY ALL), r AS (SELECT m, rr FROM s WHERE config = 'F'), x AS (SELECT config, s.rr - r.rr AS d FROM s JOIN r USING (m) WHERE config <> 'F')"


def _paired(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("molecule_id"), F.col("l_linestatus").alias("config")).agg(F.avg("l_discount").alias("rr"))
    return E.paired(s, "F")


@query(
    f"""WITH {_PAIRED} SELECT config, count(*) AS n, round(avg(d), 6) AS mean, round(1.96::DOUBLE * stddev_samp(d) / sqrt(count(*)),
        6) AS ci, CASE WHEN abs(avg(d)) > 1.96::DOUBLE * stddev_samp(d) / sqrt(count(*)) THEN CASE
            WHEN avg(d) > 0 THEN 'better' ELSE 'worse' END ELSE 'not significant' END AS verdict
    FROM x
    GROUP BY config"""
)
def a15_paired_interval(spark, d):
    return _paired(spark, d).select("config", "n", F.round("mean", 6).alias("mean"), F.round("ci", 6).alias("ci"), "verdict")


@query(
    f"""WITH {_PAIRED} SELECT config, count(*) FILTER (d > 1e-9) AS better, count(*) FILTER (d < -1e-9) AS worse,
        count(*) FILTER (abs(d) <= 1e-9) AS same
    FROM x
    GROUP BY config"""
)
def a16_better_worse(spark, d):
    return _paired(spark, d).select("config", "better", "worse", "same")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def a17_corr_slope(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"))


@query(
    """SELECT o_orderstatus, round(median(o_totalprice), 4) AS med, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lo,
        max(o_totalprice) AS hi, round(max(o_totalprice) - min(o_totalprice), 4) AS span
    FROM orders
    GROUP BY 1"""
)
def a18_median_span(spark, d):
    c = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.median(c), 4).alias("med"), F.round(F.avg(c), 4).alias("mean"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.round(F.max(c) - F.min(c), 4).alias("span"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def a19_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first FROM events WHERE event_type <> 'click' GROUP BY user_id")
def a20_first(spark, d):
    return table(spark, d, "events").where("event_type <> 'click'").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first"))


@query("SELECT p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS code FROM (SELECT DISTINCT p_brand FROM part)")
def a21_dense_code(spark, d):
    return R.dense_code(table(spark, d, "part"), "p_brand", "code")


@query("SELECT lang, round(avg((quality = 1)::INT), 6) AS kept FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def a22_keep_rate(spark, d):
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return l.groupBy("lang").agg(F.round(F.avg((F.col("quality") == 1).cast("double")), 6).alias("kept"))


@query(
    """WITH t AS (SELECT n_chars > 1500 AS guess, quality = 1 AS truth FROM labels JOIN documents USING (doc_id))
SELECT round(avg((guess = truth)::INT), 6) AS accuracy, round(greatest(avg(truth::INT), 1 - avg(truth::INT)), 6) AS base,
        count(*) FILTER (guess AND truth) AS tp, count(*) FILTER (guess AND NOT truth) AS fp,
        count(*) FILTER (NOT guess AND truth) AS fn, count(*) FILTER (NOT guess AND NOT truth) AS tn
    FROM t"""
)
def a23_gate(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("n_chars") > 1500).alias("g"), (F.col("quality") == 1).alias("t"))
    g, y = F.col("g"), F.col("t")
    share = F.avg(y.cast("double"))
    return t.agg(F.round(F.avg((g == y).cast("double")), 6).alias("accuracy"), F.round(F.greatest(share, 1 - share), 6).alias("base"), F.count_if(g & y).alias("tp"), F.count_if(g & ~y).alias("fp"), F.count_if(~g & y).alias("fn"), F.count_if(~g & ~y).alias("tn"))


@query(
    f"""WITH {C.POOL}, t AS (SELECT a.label AS label, (bit_count(a.w0 & b.w0) + bit_count(a.w1 & b.w1))::BIGINT AS i,
        a.popcount + b.popcount AS s
    FROM pooled a
    JOIN pooled b ON b.key = a.key + 1)
SELECT label::BIGINT AS label, round(sum(i)::DOUBLE / sum(s - i), 6) AS micro, round(avg(i::DOUBLE / (s - i)), 6) AS macro
    FROM t
    GROUP BY label"""
)
def a24_micro_macro(spark, d):
    from ..functions import bits as B

    p = C.pool(spark, d).select("key", "label", "fp", "popcount")
    q = p.select((F.col("key") - 1).alias("key"), F.col("fp").alias("fp2"), F.col("popcount").alias("p2"))
    t = p.join(q, "key").withColumn("i", B.common(F.col("fp"), F.col("fp2"))).withColumn("u", F.col("popcount") + F.col("p2") - F.col("i"))
    return t.groupBy(F.col("label").cast("long").alias("label")).agg(F.round(F.sum("i") / F.sum("u"), 6).alias("micro"), F.round(F.avg(F.col("i") / F.col("u")), 6).alias("macro"))


@query(
    """WITH t AS (SELECT o_custkey AS g, o_totalprice AS s, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS truth,
        o_orderstatus <> 'P' AS valid
    FROM orders),
r AS (SELECT g, 1 + count(*) FILTER (valid AND NOT truth AND s > ts) AS rank
    FROM (SELECT *, max(s) FILTER (truth) OVER (PARTITION BY g) AS ts
    FROM t)
    GROUP BY g)
SELECT round(avg((rank = 1)::INT), 6) AS top1, round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM r"""
)
def a25_listwise(spark, d):
    """Rank of the truth among the valid decoys of its list."""
    w = Window.partitionBy("o_custkey")
    t = table(spark, d, "orders").withColumn("truth", F.col("o_orderkey") == F.min("o_orderkey").over(w)).withColumn("ts", F.max(F.when(F.col("truth"), F.col("o_totalprice"))).over(w))
    r = t.groupBy("o_custkey").agg((1 + F.count_if((F.col("o_orderstatus") != "P") & ~F.col("truth") & (F.col("o_totalprice") > F.col("ts")))).alias("rank"))
    return r.agg(F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("top1"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"))


@query(
    """SELECT label::BIGINT AS owner, i::BIGINT AS bit, round(avg(embedding[i + 1]::DOUBLE), 6) AS logit
    FROM embeddings, range(0, 64) t(i)
    GROUP BY ALL"""
)
def a26_mean_logits(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("owner"), F.posexplode("embedding").alias("bit", "x"))
    return e.groupBy("owner", F.col("bit").cast("long").alias("bit")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("logit"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a27_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("n"))


# --- functions over partitions -----------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, round(CASE WHEN hi > lo THEN (o_totalprice - lo) / (hi - lo) ELSE 1 END, 6) AS x
    FROM (SELECT *, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi
    FROM orders
    WINDOW w AS (PARTITION BY o_custkey))"""
)
def w1_min_max(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(S.min_max(F.col("o_totalprice"), ["o_custkey"], 1.0), 6).alias("x"))


@query(
    """SELECT o_orderkey, round(CASE WHEN sd > 0 THEN (o_totalprice - m) / sd ELSE 0 END, 5) AS z
    FROM (SELECT *, avg(o_totalprice) OVER w AS m, stddev_pop(o_totalprice) OVER w AS sd
    FROM orders
    WINDOW w AS (PARTITION BY o_custkey))"""
)
def w2_z_score(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(S.z_score(F.col("o_totalprice"), ["o_custkey"]), 5).alias("z"))


@query(
    """SELECT label::BIGINT AS label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank
    FROM embeddings
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) <= 10"""
)
def w3_rank_cut(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", F.get("embedding", F.lit(0)).alias("x"))
    return R.top_k(e, ["label"], [F.col("x").desc(), F.col("vec_id")], 10).select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rank FROM orders")
def w4_competition_rank(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc())).cast("long").alias("rank"))


@query(
    """WITH t AS (SELECT o_custkey, o_orderpriority AS ckey, o_orderkey,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r
    FROM orders),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey, ckey ORDER BY r) = 1)
SELECT o_custkey, ckey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY r) AS rank FROM f"""
)
def w5_first_per_key(spark, d):
    t = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("ckey"), "o_orderkey").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return R.first_per_key(t, ["o_custkey"], "ckey", "rank", 25).select("o_custkey", "ckey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) AS r
    FROM orders)
SELECT o_custkey, count(*) FILTER (r <= 5) AS filled FROM t GROUP BY 1"""
)
def w6_capped_fill(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") != "F", "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).groupBy("o_custkey").agg(F.count_if(F.col("r") <= 5).alias("filled"))


@query(
    """WITH g AS (SELECT o_custkey, max(o_totalprice) AS top, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd, count(*) AS n
    FROM orders
    GROUP BY 1)
SELECT o_custkey, round(CASE WHEN n < 3 OR sd = 0 THEN 0 ELSE (top - m) / sd - sqrt(2 * ln(n)) END, 5) AS score FROM g"""
)
def w7_extreme_adjusted(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("sd"), F.count("*").alias("n"))
    return g.select("o_custkey", F.round(S.extreme_adjusted(F.col("top"), F.col("m"), F.col("sd"), F.col("n")), 5).alias("score"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2")
def w8_first_two(spark, d):
    return R.top_k(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 2).drop("rank")


@query(f"WITH {C.SPECTRA} SELECT molecule_id, arg_max(adduct, struct_pack(n := len(peaks), s := -seq)) AS adduct FROM spectra GROUP BY molecule_id")
def w9_richest_group(spark, d):
    return C.spectra(spark, d).groupBy("molecule_id").agg(F.max_by("adduct", F.struct(F.size("peaks"), -F.col("seq"))).alias("adduct"))


@query(
    """SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running
    FROM orders"""
)
def w10_running_total(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))
