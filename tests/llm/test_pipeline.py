"""The pipeline's stages, each held against brute force on its own input, over planted and generated documents."""

import hashlib
import random
import re
from collections import Counter

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from test_mixing import check_mix  # noqa: E402
from test_quality import plain as counts  # noqa: E402
from test_secret_scan import base_spans  # noqa: E402
from test_simhash import plain_components, plain_fingerprint  # noqa: E402

from evalloop.llm import mixing  # noqa: E402

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SIZE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    prose = [r.text for r in docs.limit(40).collect()]
    planted = [(900_000 + k, t, "en", "src1", len(t)) for k, t in enumerate(
        prose[:20] + [t + " again" for t in prose[20:30]]
        + [f"{t} password=abcdefgh{k} and AKIA{'Z9' * 8}" for k, t in enumerate(prose[30:40])]
        + ["", "few words", " ".join(["same five words come back"] * 40),
           " ".join(f"w{rng.randint(0, 9999)}" for _ in range(200))])]
    planted.append((None, None, None, None, None))
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        out.append(docs.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == COLUMNS
    return out


def test_stage_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mixed_sources", "tokens"]


def test_quality_keeps_clean_documents(steps, spark):
    kept = {r.doc_id for r in steps[1]}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in steps[0]:
        n = counts(r.text)
        if n[0] < 10 or 100 * n[4] > 20 * n[0]:
            assert r.doc_id not in kept
    passed = [r.doc_id in kept for r in steps[0] if good.get(r.doc_id) == 1 and counts(r.text)[4] * 5 <= counts(r.text)[0] >= 10]
    assert sum(passed) >= 0.99 * len(passed)


def test_one_of_each_group_stays(steps):
    rows = steps[1]
    least = plain_components([plain_fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    assert sorted(r.doc_id for r in steps[2]) == sorted({c for c in least})
    assert len(steps[2]) < len(rows)


def test_secrets_are_gone_and_documents_stay(steps):
    before, after = ({r.doc_id: r for r in s} for s in (steps[2], steps[3]))
    assert before.keys() == after.keys()
    changed = 0
    for k, r in before.items():
        spans = base_spans(r.text)
        changed += bool(spans)
        assert ("[SECRET]" in after[k].text) == bool(spans) and after[k].n_chars == (len(after[k].text) if spans else r.n_chars)
        assert base_spans(after[k].text) == [] or not spans
        if not spans:
            assert after[k] == r
    assert changed > 10


def test_the_mix_meets_its_targets(steps, spark):
    taken = Counter(r.doc_id for r in steps[4])
    docs = spark.createDataFrame(steps[3])
    rows = mixing.mix(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    source = {r.doc_id: r.source for r in steps[3]}
    longest = {}
    for r in steps[3]:
        longest[r.source] = max(longest.get(r.source, 0), len(SIZE.findall(r.text)))
    check_mix([(source[r.doc_id], r) for r in rows], longest)
    assert all(taken[r.doc_id] * r.size == r.taken for r in rows)


def test_tokens_equal_the_librarys(steps):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(corpus_pipeline.vocabulary())
    want = Counter()
    for r in steps[4]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, steps[5])) == want


def test_empty_and_odd_documents(spark, odd):
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, corpus_pipeline.cut_lineage(stage(spark, docs, SF))
            assert docs.columns == before or stage is corpus_pipeline.tokens
    assert docs.count() == 0


def test_run_gives_the_last_stages_rows(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50
