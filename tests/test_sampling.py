"""P12 positional index with a hot group, L3 samples, L1 limit."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalloop.operators import sampling as sm


def test_index_within_group_matches_window_with_hot_group(spark):
    # Group 0 holds a third of the rows; a null group is present too.
    rows = [(0, i) for i in range(300)] + [(g, i) for g in range(1, 101) for i in range(6)] + \
           [(None, i) for i in range(5)]
    df = spark.createDataFrame(rows, "g long, o long").repartition(7) \
        .withColumn("t", F.concat(F.lit("text é "), F.col("o").cast("string")))
    got = sm.index_within_group(df, ["g"], ["o"], "idx", num_partitions=16)
    w = Window.partitionBy("g").orderBy("o")
    ref = df.withColumn("ref", F.row_number().over(w) - 1)
    j = got.alias("a").join(ref.alias("b"), F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.o") == F.col("b.o")))
    assert j.count() == len(rows)
    assert j.filter(F.col("a.idx") != F.col("b.ref")).count() == 0
    assert j.filter(F.col("a.t") != F.col("b.t")).count() == 0  # wide columns pass through intact


def test_sample_per_group(spark):
    rows = [("a", i) for i in range(100)] + [("b", i) for i in range(2)]
    df = spark.createDataFrame(rows, "ds string, k long")
    s = sm.sample_per_group(df.repartition(5), "ds", "k", n=4).collect()
    by = {}
    for r in s:
        by.setdefault(r.ds, []).append(r)
    assert len(by["a"]) == 4 and len(by["b"]) == 2
    # deterministic and independent of input order
    s2 = sm.sample_per_group(df.orderBy(F.desc("k")), "ds", "k", n=4).collect()
    assert sorted((r.ds, r.k) for r in s) == sorted((r.ds, r.k) for r in s2)
    # equals a plain window over all rows
    from pyspark.sql import Window
    w = Window.partitionBy("ds").orderBy(F.xxhash64("k", F.lit(42)), "k")
    ref = df.withColumn("r", F.row_number().over(w)).filter("r <= 4").collect()
    assert sorted((r.ds, r.k) for r in s) == sorted((r.ds, r.k) for r in ref)


def test_head_limit_truthiness(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    assert sm.head_limit(df, None, ["i"]).count() == 10
    assert sm.head_limit(df, 0, ["i"]).count() == 10
    assert [r.i for r in sm.head_limit(df, 3, ["i"]).collect()] == [0, 1, 2]


def test_latest_checkpoint(spark):
    df = spark.createDataFrame([("r", "checkpoint-10"), ("r", "checkpoint-9"), ("r", "other")], "run string, name string")
    r = sm.latest_by_step(df, ["run"], "name").first()
    assert (r.name, r.step) == ("checkpoint-10", 10)


def test_positions_of_many_wide_rows(spark):
    """400,000 rows in 5 groups with a text beside them: more than a range sample holds."""
    df = spark.range(400_000).select(
        F.concat(F.lit("g"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).cast("string")).alias("g"),
        ((F.col("id") * 48271) % 1_000_003).alias("o"), F.repeat(F.col("id").cast("string"), 20).alias("text"))
    got = sm.index_within_group(df, ["g"], ["o"], "idx", num_partitions=24)
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    both = got.join(want, ["g", "o", "text"])
    assert got.count() == 400_000 == both.count()
    assert both.filter("idx <> want").count() == 0


def test_ties_take_the_positions_of_their_tie(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), (None, None, "n")], "g string, o int, t string")
    got = {r.t: r.idx for r in sm.index_within_group(df, ["g"], ["o"]).collect()}
    assert sorted([got["x"], got["y"]]) == [0, 1] and (got["z"], got["n"]) == (2, 0)


def test_only_keys_are_range_partitioned_and_only_once(spark):
    """The wide rows meet their positions in a join; what is left of the plan holds no range exchange and no Python."""
    import contextlib
    import io

    df = spark.range(1000).select((F.col("id") % 5).alias("g"), F.col("id").alias("o"), F.lit("text").alias("t"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        sm.index_within_group(df, ["g"], ["o"]).explain("formatted")
    assert "rangepartitioning" not in out.getvalue() and "Python" not in out.getvalue() and "MapIn" not in out.getvalue()


def test_more_outputs_than_the_sampler_draws_are_an_error(spark):
    import pytest

    c = spark.createDataFrame([("q", 0), ("q", 1), ("q", 2)], "key string, cand_idx int")
    assert sm.bounded_outputs(c, 3).count() == 3
    with pytest.raises(Exception, match="more than 2 outputs"):
        sm.bounded_outputs(c, 2).collect()


def test_positions_are_unique_on_ties(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", None), ("b", None), ("b", 7), (None, 3)] + [("hot", 5)] * 3000 + [("hot", 6)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(7)
    got = {}
    for r in sm.index_within_group(df, ["g"], ["k"]).collect():
        got.setdefault(r.g, []).append((r.idx, r.k))
    for group, found in got.items():
        assert [i for i, _ in sorted(found, key=lambda x: x[0])] == list(range(sum(g == group for g, _ in rows)))
        in_order = [k for _, k in sorted(found, key=lambda x: x[0])]
        assert in_order == sorted(in_order, key=lambda x: (x is not None, x or 0))


def test_the_limit_of_a_sample_is_built_in(spark, capsys):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS k")
    sm.sample_per_group(df, "g", "k", 4).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") >= 2 and "Arrow" not in plan and "Pandas" not in plan


def test_small_groups_take_one_shuffle_and_hot_ones_are_spread(spark, monkeypatch, capsys):
    """Groups below the limit meet no join and no stored copy of their keys; beside hot ones the positions are the same."""
    rows = [(g, i) for g in range(40) for i in range(5)] + [(77, i) for i in range(400)] + [(None, i) for i in range(3)]
    df = spark.createDataFrame(rows, "g long, o long").repartition(5)
    sm.index_within_group(df, ["g"], ["o"]).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "positions-" not in plan and plan.count("hashpartitioning(g") == 1
    whole = sorted(map(str, sm.index_within_group(df, ["g"], ["o"]).collect()))
    monkeypatch.setattr(sm, "HOT_ROWS", 100)
    assert sorted(map(str, sm.index_within_group(df, ["g"], ["o"]).collect())) == whole
    sm.index_within_group(df, ["g"], ["o"]).explain()
    assert "Join" in capsys.readouterr().out
