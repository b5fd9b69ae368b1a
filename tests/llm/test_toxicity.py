import random
import zlib

import numpy as np

from evalloop.llm import queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def out_of_fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op4_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == out_of_fold(r.doc_id) for r in rows)
    judged = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [p for t, p in judged if t == 1], [p for t, p in judged if t == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_a_pair_that_no_additive_model_tells(spark, documents):
    """Insults and groups are harmless alone and toxic together; both are equally frequent in either class."""
    rng = random.Random(4)
    insults, groups = ["vermin", "filthy", "rotten"], ["martians", "venusians", "saturnians"]
    rows, marks = [], []
    for k in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.choice('abcdefgh')}x" for _ in range(20)] + [rng.choice(insults)] * a + [rng.choice(groups)] * b
        rng.shuffle(words)
        rows.append((k, " ".join(words), "en", "s", 0))
        marks.append((k, 1, int(a and b)))
    df, labels = documents(rows), spark.createDataFrame(marks, LABELS)
    got = toxicity.toxicity(df, labels).collect()
    right = np.mean([r.predicted == marks[r.doc_id][2] for r in got if r.held_out])
    assert right >= 0.97
    again = {r.doc_id: r.score for r in toxicity.toxicity(df.repartition(3), labels).collect()}
    assert all(abs(r.score - again[r.doc_id]) < 1e-12 for r in got)


def test_rows_of_a_repeated_id_are_bounded_and_do_not_outweigh_the_others(spark, documents):
    """A third of the rows repeat one labelled id, half of them as copies of one text."""
    hot = next(k for k in range(10_000, 10_100) if not out_of_fold(k))
    rows = [(k, f"plain words {k} " + "vermin " * (k % 2), "en", "s", 0) for k in range(600)]
    rows += [(hot, f"vermin talk {k if k % 2 else 'again'}", "en", "s", 0) for k in range(300)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(600)] + [(hot, 1, 0)], LABELS)
    df = documents(rows)
    drawn = toxicity.sample(df, labels, "doc_id", "text", "toxic", 50).collect()
    assert len(drawn) == 100 and sum(r.label for r in drawn) == 50
    assert len({(r._id, r.text) for r in drawn}) == 100 and sum(r._id == hot for r in drawn) <= 5
    whole = toxicity.sample(df, labels, "doc_id", "text", "toxic", 5000).collect()
    of_hot = {r.text: r.weight for r in whole if r._id == hot}
    assert len(of_hot) == 151 and abs(sum(of_hot.values()) - 1) < 1e-3 and abs(of_hot["vermin talk again"] - 0.5) < 1e-3
    assert all(r.weight == 1 for r in whole if r._id != hot)
    got = toxicity.toxicity(df, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id != hot)


def test_gradient_of_the_machine():
    """One small step lowers the loss as much as finite differences say."""
    rows, labels = [[0, 1], [1, 2], [0], []], np.array([1.0, 0.0, 0.0, 1.0])
    machine = toxicity.Machine([10, 11, 12], rank=2)
    def loss(m):
        p = 1 / (1 + np.exp(-m.raw(rows)))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))
    before = loss(machine)
    machine.fit(rows, labels, epochs=200)
    assert loss(machine) < 0.6 * before
    brute = [machine.bias + sum(machine.weight[r]) + sum(machine.factor[a] @ machine.factor[b] for i, a in enumerate(r) for b in r[i + 1:]) for r in rows]
    assert np.allclose(machine.raw(rows), brute)


def test_odd_rows(spark, odd):
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.toxicity(odd, none).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.5}
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (5, 1, 0), (1, None, 1), (2, 1, None), (None, 1, 1), (8, 0, 0), (99, 0, 1)], LABELS)
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0
