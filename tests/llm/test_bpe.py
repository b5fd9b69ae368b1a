import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from evalloop.llm import bpe, queries  # noqa: E402


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    return bpe.codec(bpe._spec(P.path("byte_bpe_50k.json")))


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(max_size=40))
def test_ids_equal_the_librarys(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_runs_special_tokens_and_partial_characters(own, library):
    rng = random.Random(5)
    texts = ["a" * 3000, "<|endoftext|>x<|endoftext|><|endoftext|>", "it's  we'll\n\n x \x85\xa0　y"]
    texts += ["".join(rng.choice(letters) for _ in range(60)) for letters in ["ab", "the in", "aab "] for _ in range(200)]
    assert [own.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    some = library.encode("中\U0001f600").ids[:-1]
    assert own.decode(some) == library.decode(some, skip_special_tokens=False)


def test_remembered_pieces_turn_over(own, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    fresh = bpe.Pieces(own.encode_piece)
    words = [f" w{k}" for k in range(40)] * 3
    assert [fresh[w] for w in words] == [",".join(map(str, own.encode_piece(w))) for w in words]
    assert len(fresh) <= 10 and len(fresh.old) <= 10


def test_odd_rows(spark, odd, library):
    path = P.path("byte_bpe_50k.json")
    rows = [r for r in bpe.round_trip(odd, path).collect()]
    want = sorted((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(),
                   hashlib.sha256((r.text or "").encode()).hexdigest())
                  for r in odd.collect() for i in [library.encode(r.text or "").ids])
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    both = bpe.decode(bpe.encode(odd, path), path).collect()
    assert all(r.decoded == (r.text or "") and r.ids == library.encode(r.text or "").ids for r in both)
    assert bpe.round_trip(odd.limit(0), path).count() == 0


def test_query_over_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op7_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
