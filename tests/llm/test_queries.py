"""Every registered query over a whole small table: columns, rows, and the SQL twin where there is one."""

import pytest
from compare import difference, type_differences

from rimlight.llm.queries import QUERIES, TWINS

COLUMNS = {
    "op1": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op2": {"doc_id", "held_out", "score", "predicted"},
    "op3": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op4": {"doc_id", "held_out", "lang_pred", "score"},
    "op5": {"query_id", "rank", "vec_id", "score"},
    "op6": {"doc_id", "leaked", "item_ids", "coverage"},
    "op7": {"doc_id", "n_shingles", "component_id"},
    "op8": {"doc_id", "held_out", "score", "predicted"},
    "op9": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op10": {"doc_id", "size", "source_size", "target", "taken"},
    "op11": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
    "op12": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op13": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
}


def test_one_query_an_operator():
    assert {name.split("_")[0] for name in QUERIES} == set(COLUMNS) and len(QUERIES) == len(COLUMNS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    assert set(df.columns) >= COLUMNS[name.split("_")[0]]
    if name in TWINS:
        assert type_differences(df, duck, TWINS[name]) == []
        assert difference(df, duck, TWINS[name]) is None
        return
    rows = df.collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if name.startswith("op5"):
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        assert len(rows) == 10 * vectors.where("vec_id % 100 = 0").count()
    else:
        assert len(rows) == docs and len({r.doc_id for r in rows}) == docs
    if "score" in df.columns and "predicted" in df.columns:
        assert all(0 <= r.score <= 1 for r in rows)
