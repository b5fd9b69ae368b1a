"""The registered queries: one per operator and the pipeline, over whole tables, with the columns they promise."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ("documents", ["doc_id", "size", "source_size", "target", "taken"]),
    2: ("pages", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]),
    3: ("pages", ["page_id", "host", "path", "rule", "verdict"]),
    4: ("documents", ["doc_id", "held_out", "score", "predicted"]),
    5: ("documents", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
    6: ("documents", ["doc_id", "fingerprint", "component_id"]),
    7: ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    8: ("embeddings", ["vec_id", "n_links", "component_id", "kept"]),
    9: ("documents", ["doc_id", "held_out", "lang_pred", "score"]),
    10: ("documents", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    11: (None, ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]),
    12: ("documents", ["doc_id", "n_bytes", "n_tokens", "over_limit"]),
    13: (None, ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]),
}


def named():
    return {int(m[1]): name for name in E.queries() if (m := re.match(r"op(\d+)_", name))}


def test_all_are_registered():
    assert sorted(named()) == sorted(COLUMNS) and "pipeline" in E.queries()
    assert {"op1_mixing", "op2_warc", "op8_embeddings", "op11_collocations", "op13_conversation_trie"} <= set(E.oracle_sql())


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_rows_and_columns(spark, n):
    source, columns = COLUMNS[n]
    df = E.queries()[named()[n]](spark, SF)
    assert df.columns == columns
    assert source is None or df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


NATIVE = ["op1_mixing", "op3_url_filter", "op5_secrets", "op10_quality"]


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_run_no_python(spark, name, capsys):
    E.queries()[name](spark, SF).explain("formatted")
    assert not re.search("Python|Pandas|Arrow|MapIn", capsys.readouterr().out)
