import pytest

from tessera.llm.queries import QUERIES

COLUMNS = {
    "op1_": {"doc_id", "held_out", "score", "predicted"},
    "op2_": {"doc_id", "fingerprint", "component_id"},
    "op3_": {"page_id", "url", "text", "n_chars"},
    "op4_": {"doc_id", "item_id", "similarity"},
    "op5_": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op6_": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op7_": {"doc_id", "n_words", "n_pieces"},
    "op8_": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op9_": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op10_": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op11_": {"doc_id", "held_out", "score", "predicted"},
    "op12_": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op13_": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
}
TABLES = {"op3_": ("page_id", "pages"), "op12_": ("conv_id", "conversations"), "op13_": ("vec_id", "embeddings")}


@pytest.mark.parametrize("start", COLUMNS)
def test_query_covers_its_table(spark, sf_dir, start):
    (name,) = [n for n in QUERIES if n.startswith(start)]
    got = QUERIES[name](spark, sf_dir)
    assert set(got.columns) >= COLUMNS[start]
    key, name = TABLES.get(start, ("doc_id", "documents"))
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ids, every = {r[0] for r in got.select(key).collect()}, {r[0] for r in table.select(key).collect()}
    assert ids <= every if start in ("op4_", "op12_") else ids == every


def test_native_operators_run_no_python(spark, sf_dir):
    for start in ("op4_", "op9_", "op10_"):
        (name,) = [n for n in QUERIES if n.startswith(start)]
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow")), name
