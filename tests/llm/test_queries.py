"""The registered queries' columns, and that they cover whole tables."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "item_id"],
    "op2": ["doc_id", "held_out", "lang_pred", "score"],
    "op3": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4": ["doc_id", "n_shingles", "component_id"],
    "op5": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op7": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op9": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op10": ["doc_id", "n_chars", "n_tokens"],
    "op11": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op12": ["doc_id", "held_out", "score", "predicted"],
}
NAMES = {n.split("_")[0]: n for n in entry.queries() if n.startswith("op")}


def test_one_query_for_each_operator():
    assert set(NAMES) == set(COLUMNS) and "pipeline" in entry.queries() and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_columns_and_rows(spark, op):
    got = entry.queries()[NAMES[op]](spark, SF)
    assert got.columns[: len(COLUMNS[op])] == COLUMNS[op]
    key, name = ("vec_id", "embeddings") if op == "op11" else ("doc_id", "documents")
    ids = {r[key] for r in got.select(key).distinct().collect()}
    known = {r[key] for r in spark.read.parquet(f"{SF}/{name}.parquet").select(key).collect()}
    assert ids == known if op != "op1" else ids <= known


@pytest.mark.parametrize("name", ["op4_jaccard", "op5_suffixes", "op8_blocks"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in entry.queries()[name](spark, SF).select(*columns).collect()) == sorted(want.fetchall())
