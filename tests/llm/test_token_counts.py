"""Token counts: equal to the library on every kind of text, whatever the frequent table holds."""

import pyarrow as pa
import pytest

from evalloop.llm import bpe, token_counts as tc
from evalloop.llm.queries import vocabulary

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary())
    own.no_truncation()
    own.no_padding()
    return lambda text: len(own.encode(text or "", add_special_tokens=False).ids)


def test_table_finds_what_it_holds_and_nothing_else():
    keys = [f"w{k}" for k in range(5000)]
    table = tc.LengthTable(keys, [k % 9 + 1 for k in range(5000)])
    asked = pa.array(["w17", "nothing", "w4999", "", "w0"])
    assert table.find(asked).tolist() == [9, -1, 5, -1, 1]
    assert tc.LengthTable([], []).find(asked).tolist() == [-1] * 5
    assert table.find(pa.array([], pa.string())).tolist() == []


def test_keys_with_one_home_are_told_apart(monkeypatch):
    monkeypatch.setattr(tc.LengthTable, "_home", lambda self, keys: __import__("numpy").zeros(len(keys), dtype="int64"))
    table = tc.LengthTable(["a", "b", "c"], [1, 2, 3])
    assert table.find(pa.array(["c", "x", "a", "b"])).tolist() == [3, -1, 1, 2]


@pytest.mark.parametrize("entries", [0, 50, tc.ENTRIES])
def test_counts_equal_the_library(spark, library, entries):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = tc.counts(docs, vocabulary(), entries=entries).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == docs.count()
    for row in got:
        text = texts[row["doc_id"]]
        assert row["n_tokens"] == library(text) and row["over_limit"] == (row["n_tokens"] > 1024)
        assert row["n_bytes"] == len((text or "").encode())


def test_odd_rows(odd, library):
    got = tc.counts(odd, vocabulary())
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == odd.count()
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, library(r["text"])) for r in odd.collect()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in rows) == want


def test_special_strings_long_texts_and_empty_tables(documents, library, monkeypatch):
    monkeypatch.setattr(tc, "TOGETHER", 7)
    monkeypatch.setattr(tc, "LONG_TEXT", 50)
    texts = ["a <|endoftext|> b<|endoftext|>", "é" * 300 + " 中文" * 50, "x" * 5000, "one two  three\n\n four " * 40, "<|endoftext|>", "", None]
    own = tc.Lengths(bpe.codec(bpe._spec(vocabulary())), tc.LengthTable([" two", "one"], [1, 1]))
    assert own.count(t or "" for t in texts) == [library(t) for t in texts]
    assert tc.counts(documents([]), vocabulary()).collect() == []


def test_no_pre_token_is_shuffled(spark, capsys):
    tc.counts(spark.read.parquet(f"{SF}/documents.parquet"), vocabulary()).explain("formatted")
    assert "Exchange" not in capsys.readouterr().out
