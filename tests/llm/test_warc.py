import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloop.llm import queries, warc

SF = "/root/testdata/sf0.001"
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])

LONG = "é" * 200_000
TRICKY = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9
ODD = [(7, "http://a.b/c", "x" * 100), (3, "http://A.b/c?q#f", "x" * 100), (3, "http://a.b/c", "x" * 100), (None, None, "x" * 100),
       (8, "no scheme", "x" * 99), (9, "http://u@H/", "x" * 99), (10, "http://h/\r\nX: y", None), (11, "", ""), (12, "http://é/中", LONG),
       (13, "http://h", TRICKY), (14, "http://h", "\r\n\r\n"), (15, "http://h", "\n" + "y" * 120 + "\r\n\r\n")]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame(ODD, PAGES).withColumns({c: F.lit("x") for c in ("first", "of", "digest", "bytes", "_run", "part")})


def want(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [k for k, _, h in rows if (h or "").encode() == body and k is not None]
        first = min(same) if same and len(body) >= 100 else None
        revisit = first is not None and i != first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip_of_odd_rows(pages):
    got = warc.archive(pages).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == want(ODD)
    keys = {r.page_id: r.url_key for r in got}
    assert keys[7] == "b,a)/c" and keys[9] == "h)/" and keys[12] == "é)/中" and keys[11] == ")/"
    assert warc.archive(pages.limit(0)).count() == 0


def test_histories_are_in_global_order(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, rng.choice(["http://hot.example/x", f"http://h{k % 50}.org/{rng.randint(0, 9)}"]), f"body {k}") for k in range(3000)]
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 150 * warc.SIZE_CLASSES[0])
    pages = spark.createDataFrame(rows, PAGES).repartition(6)
    runs = warc.cut_lineage(_runs(pages))
    assert runs.select("file").distinct().count() >= 18
    got = sorted(warc.merge(runs, 300).collect(), key=lambda r: (r.part, r.position))
    assert [warc.order(r) for r in got] == sorted(warc.order(r) for r in got)
    assert sorted(r.page_id for r in got) == list(range(3000))
    assert len({r.part for r in got if r.url_key == "example,hot)/x"}) > 1  # a hot URL spreads
    for p in {r.part for r in got}:
        assert [r.position for r in got if r.part == p] == list(range(sum(r.part == p for r in got)))


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    import glob

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    monkeypatch.setattr(warc, "SIZE_CLASSES", (1_000, 10_000))
    rows = [(k, f"http://h/{k}", chr(97 + k % 26) * size) for k, size in enumerate([10] * 300 + [5_000] * 30 + [60_000] * 3)]
    path = f"{warc.ensure_checkpoint_dir(spark)}/warc-test-{random.random()}"
    warc.write(spark.createDataFrame(rows, PAGES).repartition(1), path)
    sizes = sorted(len(open(f, "rb").read()) for f in glob.glob(f"{path.removeprefix('file://')}/*/part-*"))
    assert len([s for s in sizes if s > 60_000]) == 3 and all(s < 60_000 * 1.1 for s in sizes)
    assert warc.histories(spark, path).count() == len(rows)


def _runs(pages):
    spark = pages.sparkSession
    path = f"{warc.ensure_checkpoint_dir(spark)}/warc-test-{random.random()}"
    warc.write(pages, path)
    return warc.sorted_runs(spark, path)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree_merges_runs(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 20), r, n) for n in range(rng.choice([0, 1, 5, 40]))) for r in range(k)]
    got = list(warc.LoserTree([iter(r) for r in runs], lambda e: e[0]))
    assert got == sorted((e for r in runs for e in r), key=lambda e: (e[0], e[1]))


def test_damaged_archives_are_refused():
    record = b"WARC/1.0\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    assert [p for _, p, _, _ in warc.records(record * 2)] == [b"abcde"] * 2
    with pytest.raises(ValueError):
        list(warc.records(record[:-3]))
    with pytest.raises(ValueError):
        list(warc.records(b"x" + record))


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    rows = con.sql(queries.ORACLE_SQL["op2_warc"]).fetchall()
    assert sorted(map(tuple, queries.op2_warc(spark, SF).collect()), key=repr) == sorted(rows, key=repr)


def test_ids_at_both_ends_and_any_time_zone(spark):
    big = (1 << 63) - 1
    rows = [(big, "http://a/", "x"), (-big - 1, "http://a/", "y"), (1 << 60, "http://a/", "z"), (5, "http://a/", "w")]
    pages = spark.createDataFrame(rows, PAGES)
    first = sorted((r.page_id, r.captured_at) for r in warc.archive(pages).collect())
    assert [i for i, _ in first] == sorted(r[0] for r in rows) and (5, "2023-11-14T22:13:25Z") in first
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert sorted((r.page_id, r.captured_at) for r in warc.archive(pages).collect()) == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
