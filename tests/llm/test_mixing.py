import random

import duckdb
import pytest

from evalloop.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def reshared(sizes, weights=(3, 1, 2), total=1.5, most=2):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    full, rest = {}, dict(w)
    while rest:
        left = total * sum(sizes.values()) - sum(full.values())
        share = {s: left * w[s] / sum(rest.values()) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = most * sizes[s]
            rest.pop(s)
    return full


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "z", "\U0001f600", "ﬁ", "aa"][: rng.randint(1, 9)]
    sizes = {s: rng.choice([0, 1, 5, 100, 10_000]) * rng.randint(1, 9) for s in names}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = reshared(sizes)
    assert {r.source: r.target for r in got} == pytest.approx(want)


def check_mix(rows, longest):
    """Targets, epochs and limits of a mix; ``longest``: the largest document of each source."""
    sizes, taken = {}, {}
    for source, r in rows:
        sizes[source] = sizes.get(source, 0) + r.size
        taken[source] = taken.get(source, 0) + r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = reshared(sizes)
    for source, r in rows:
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        if r.target >= r.source_size:
            assert r.taken >= r.size  # complete epochs come first
        assert abs(taken[source] - r.target) <= longest[source] / 2 + 1


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()
    source = {r.doc_id: r.source for r in docs}
    got = queries.op1_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(source)
    longest = {}
    for r in got:
        longest[source[r.doc_id]] = max(r.size, longest.get(source[r.doc_id], 0))
    check_mix([(source[r.doc_id], r) for r in got], longest)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op1_mixing(spark, SF).collect()))


def test_shares_do_not_change_the_answer(spark, monkeypatch):
    one = sorted(map(tuple, queries.op1_mixing(spark, SF).collect()))
    for shares in (1, 7):
        monkeypatch.setattr(mixing, "SHARES", shares)
        assert sorted(map(tuple, queries.op1_mixing(spark, SF).collect())) == one


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = sorted(con.sql(queries.ORACLE_SQL["op1_mixing"]).fetchall())
    got = sorted(map(tuple, queries.op1_mixing(spark, SF).collect()))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_better_documents_come_first(spark, documents):
    docs = documents([(k, f"w{k} x y", "en", "a" if k % 4 else "b", 5) for k in range(4000)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(4000)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels).collect()
    a = [r for r in rows if r.doc_id % 4]
    assert a[0].target % a[0].source_size > 0
    extra = {q: sum(r.taken % (2 * r.size) == r.size if r.target > r.source_size else r.taken > 0
                    for r in a if r.doc_id % 2 == q) / sum(r.doc_id % 2 == q for r in a) for q in (0, 1)}
    counted = {q: sum(r.taken for r in a if r.doc_id % 2 == q) / sum(r.size for r in a if r.doc_id % 2 == q) for q in (0, 1)}
    assert counted[1] > counted[0] and extra


def test_odd_rows(spark, odd, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixing.mix(odd, none).collect()
    assert len(rows) == odd.count()
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.taken)
    assert len(by[5]) == 1  # repeated rows go together
    assert mixing.mix(odd.limit(0), none).count() == 0
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    out = mixing.mixed(odd, labels)
    assert out.columns == odd.columns
    want = {}
    for r in mixing.mix(odd, labels).collect():
        if r.size:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken // r.size
    got = {}
    for r in out.filter("text rlike '[^ \\t\\n]'").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mixed(odd.limit(0), labels).count() == 0


@pytest.mark.parametrize("copies", [(1000, 0), (700, 300)])
def test_a_source_of_equal_rows_meets_its_target(spark, documents, copies):
    text = "one two three four five six seven eight nine"
    rows = [(k, f"{text} {k}", "en", "a", 0) for k in range(400)] + [(7, text, "en", "b", 0)] * copies[0] + [(None, text, "en", "b", 0)] * copies[1]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(rows).repartition(6)
    got = mixing.mix(docs, none).collect()
    assert len(got) == len(rows)
    b = [r for r in got if r.source_size == 9000]
    assert len(b) == 1000 and abs(sum(r.taken for r in b) - b[0].target) <= 5
    assert b[0].target % 9000 > 100  # the budget ends among the copies
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), none).collect()))
    out = mixing.mixed(docs, none)
    assert out.filter("source = 'b'").count() == sum(r.taken for r in b) // 9
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", none.toPandas())
    con.execute("CREATE VIEW d AS SELECT doc_id::BIGINT AS doc_id, text, source FROM documents")
    sql = queries.ORACLE_SQL["op1_mixing"].replace("FROM documents d", "FROM d")
    assert sorted((str(r[0]), r[4]) for r in con.sql(sql).fetchall()) == sorted((str(r.doc_id), r.taken) for r in got)
