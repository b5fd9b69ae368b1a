"""Library operators without a registered query of their own."""

import tempfile

from pyspark.sql import functions as F

from evalloop.functions import text as tx
from evalloop.operators import merge as mg
from evalloop.operators import sampling as sm
from evalloop.operators import shaping as sh
from evalloop.sources import io


def test_resolve_split(spark):
    root = tempfile.mkdtemp(prefix="evalloop-splits-")
    df = spark.createDataFrame([(1, "train"), (2, "validation"), (3, "train")], "id int, split string")
    df.write.partitionBy("split").parquet(root + "/t")
    assert [r.id for r in io.resolve_split(spark, root + "/t").collect()] == [2]           # validation > train
    assert sorted(r.id for r in io.resolve_split(spark, root + "/t", "train").collect()) == [1, 3]
    assert [r.id for r in io.resolve_split(spark, root + "/t", "nope").collect()] == [2]


def test_run_index(spark):
    idx = io.run_index(spark, "r", [("stat", 0, "/a"), ("training", 1, "/b")])
    assert idx.count() == 2 and idx.columns == ["run_name", "role", "iter", "path"]


def test_seeded_shuffle_reproducible(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    a = [r.k for r in sm.seeded_shuffle(df, ["k"], 42).orderBy("shuffle_key").collect()]
    b = [r.k for r in sm.seeded_shuffle(df.orderBy(F.desc("k")), ["k"], 42).orderBy("shuffle_key").collect()]
    c = [r.k for r in sm.seeded_shuffle(df, ["k"], 7).orderBy("shuffle_key").collect()]
    assert a == b and a != c and sorted(a) == list(range(50))


def test_missing_shards(spark):
    idx = spark.createDataFrame([({"w1": "a.bin", "w2": "b.bin", "w3": "a.bin"},)], "weight_map map<string,string>")
    listing = spark.createDataFrame([("a.bin",)], "file string")
    assert [r.file for r in sm.missing_shards(idx, listing).collect()] == ["b.bin"]


def test_pick_one(spark):
    reg = spark.createDataFrame([("x",), ("y",), ("z",)], "name string")
    assert sm.pick_one(reg, "name").count() == 1


def test_tag_provenance(spark):
    df = spark.createDataFrame([(3, "q3"), (1, "q1")], "pos int, problem string")
    t = sh.tag_provenance(df, "aime", "org/aime", "hard", ["pos"]).collect()
    assert {(r.problem, r._sample_index) for r in t} == {("q1", 0), ("q3", 1)}
    assert {r._dataset_id for r in t} == {"org/aime"}


def test_exact_dedup(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y")], "instruction string, output string")
    assert mg.exact_dedup(df, ["instruction", "output"]).count() == 2


def test_recover_user_text(spark):
    df = spark.createDataFrame([
        ("<|im_start|>user\n  What is 2+2?\nPlease reason step by step, and box it.<|im_end|>",),
        ("plain prompt",), ("",)], "p string")
    got = [r.u for r in df.select(tx.recover_user_text("p").alias("u")).collect()]
    assert got == ["What is 2+2?", "plain prompt", ""]


def test_response_text(spark):
    schema = ("ot string, output array<struct<type:string, content:array<struct<type:string, "
              "text:string, output_text:string>>>>")
    df = spark.createDataFrame([
        ("direct", None),
        (" ", [("message", [("output_text", "a", None), ("refusal", "no", None), ("text", None, "b")]),
               ("reasoning", [("output_text", "hidden", None)])]),
        (None, []),
    ], schema)
    got = [r.t for r in df.select(tx.response_text("ot", "output").alias("t")).collect()]
    assert got == ["direct", "a\nb", ""]
