"""The jobs: reruns, growing input, and odd rows."""

import json
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from jobs import common, consensus, holdout

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["job1_holdout", "job2_consensus"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF)
    assert got.columns == columns and rows(got) == sorted(want.fetchall(), key=repr)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_consensus_takes_only_what_is_new(spark, tmp_path, caplog):
    events = spark.read.parquet(f"{SF}/events.parquet")
    parts = events.randomSplit([0.5, 0.3, 0.2], seed=4)
    folder, config = tmp_path / "in", common.configured("consensus") | {"buckets": 8, "files_per_batch": 1}
    run = lambda: consensus.run(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "progress"), config)
    for k, part in enumerate(parts):
        part.coalesce(2).write.mode("append").parquet(str(folder))
        with caplog.at_level("INFO", "lodestone.jobs"):
            path = run()
        assert f"read {part.count()} new rows" in caplog.text
        seen = parts[0]
        for p in parts[1 : k + 1]:
            seen = seen.unionByName(p)
        whole = consensus.clusters(consensus.once(consensus.clean(seen, 8).selectExpr("*", "0L AS batch")), config["width_micro"])
        assert rows(consensus.rows(spark, path)) == rows(whole.select(*consensus.rows(spark, path).columns))
    before = files(tmp_path / "out" / "library")
    run()
    assert {k: v for k, v in files(tmp_path / "out" / "library").items() if k in before} == before
    # One molecule's new peaks leave other buckets' files alone.
    spark.createDataFrame([(10**9, None, 3, "view", 5.5, '{"k": 1}')], consensus.EVENTS).write.mode("append").parquet(str(folder))
    run()
    assert {k.split("bucket=")[1][0] for k in before if files(tmp_path / "out" / "library").get(k) != before[k]} <= {"3"}


def test_consensus_repeats_a_batch_after_a_failure(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{SF}/events.parquet").limit(500).coalesce(1).write.parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"))
    made = consensus.clusters
    monkeypatch.setattr(consensus, "clusters", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        consensus.run(*args)
    monkeypatch.setattr(consensus, "clusters", made)
    got = consensus.rows(spark, consensus.run(*args))
    assert got.agg({"n_peaks": "sum"}).first()[0] == 500


def test_consensus_odd_rows(spark, tmp_path):
    nan = float("nan")
    odd = [(1, None, 1, "a", 5.0, '{"k": 1}'), (1, None, 1, "a", 5.0, '{"k": 1}'), (2, None, None, "a", 5.0, '{"k": 1}'), (3, None, 1, None, 5.0, '{"k": 1}'), (4, None, 1, "a", None, '{"k": 1}'), (5, None, 1, "a", nan, '{"k": 1}'), (6, None, 1, "a", 5.0, None), (7, None, 1, "a", 5.0, '{"k": "x"}'), (8, None, -1, "", 7.0, '{"k": 0}'), (None, None, 1, "a", 5.0, '{"k": 1}'), (9, None, 1, "a", 6.5, '{"k": 3}')]
    spark.createDataFrame(odd, consensus.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = consensus.rows(spark, consensus.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")))
    assert rows(got) == rows(spark.createDataFrame([(-1, "", 7_000_000, 7_000_000, 1, 1, 7.0, 15), (1, "a", 5_000_000, 6_500_000, 2, 6, 6.0, 1)], consensus.LIBRARY))


def test_consensus_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = consensus.rows(spark, consensus.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")))
    assert got.collect() == []


def test_holdout_reruns_and_odd_rows(spark, tmp_path):
    docs = [(1, "A  b", "en", "core"), (2, "a B ", "en", "src4"), (3, "only held", "de", "src5"), (4, "only held", "de", "src6"), (5, None, "en", "core"), (6, " \n", "en", "core"), (None, "no id", None, None), (7, "no lang", "", "core"), (8, "a b", "en", "core")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumnRenamed("x", "y").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(8, 1), (1, 0), (1, 0), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "l"))
    run = lambda: rows(holdout.rows(spark, holdout.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "o"))))
    got = run()
    assert got == run() and len(got) == 4
    by = {r[1]: r for r in got}
    assert set(by) == {8, 3, None, 7} and by[8][4:8] == (1, 3, 2, True) and by[8][8] != "held" and by[3][8:] == ("held", "de") and by[7][9] == by[None][9] == "none"
    summary = spark.read.parquet(str(tmp_path / "o" / "summary"))
    assert summary.agg({"rows": "sum"}).first()[0] == 7
    # Another configuration leaves nothing of the split before.
    path = holdout.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "o"), common.configured("holdout") | {"held_out_sources": [], "validation_percent": 100})
    assert {r.split for r in holdout.rows(spark, path).collect()} == {"validation"}


def test_holdout_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "l"))
    assert rows(holdout.rows(spark, holdout.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "o")))) == []


def test_configuration(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"buckets": 3}))
    assert common.configured("consensus", str(tmp_path / "c.json")) == common.configured("consensus") | {"buckets": 3}
    (tmp_path / "c.json").write_text(json.dumps({"bucket": 3}))
    with pytest.raises(ValueError, match="bucket"):
        common.configured("consensus", str(tmp_path / "c.json"))


def test_command_line(tmp_path):
    root = __file__.rsplit("/", 2)[0]
    done = subprocess.run([sys.executable, "-m", "jobs.holdout", "--documents", f"{SF}/documents.parquet", "--labels", f"{SF}/labels.parquet", "--output", str(tmp_path / "o")], cwd=root, capture_output=True, text=True, timeout=300, check=True)
    assert "wrote split=train" in done.stderr and list((tmp_path / "o" / "rows").rglob("*.parquet"))


def test_holdout_normalises_each_text_once(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plan = holdout.split(holdout.keyed(docs, labels, ["src4"]), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_holdout_keys_are_those_of_the_plain_pattern(spark):
    texts = ["A  b\t\nC", " a B\rc\f ", " a b c", "A　B", "\t\n\r\f  ", "", None, "\t x\n\n\ny  ", "Z\x0by", "Ä \t Ö"]
    docs = spark.createDataFrame([(k, t, "en", "src1") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r.key for r in holdout.keyed(docs, labels, []).collect()}
    plain = docs.selectExpr("doc_id", r"lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' '))) AS n").where("n <> ''").selectExpr("doc_id", "sha2(n, 256) AS key")
    assert got == {r.doc_id: r.key for r in plain.collect()} and got[0] == got[1]


def test_best_with_puts_nulls_last(spark):
    from pyspark.sql import functions as F

    from lodestone.operators.ranking import best_with

    table = spark.createDataFrame([("a", None, 1, "z"), ("a", 3, None, "y"), ("a", 3, 5, "x"), ("a", 2, 0, "w"), ("b", None, None, "v"), ("b", None, None, "u")], "g string, q int, i long, t string")
    got = sorted(map(tuple, best_with(table, ["g"], [("q", True), ("i", False)], F.count("*").alias("n")).collect()))
    assert got == [("a", 3, 5, "x", 4), ("b", None, None, "u", 2)]
