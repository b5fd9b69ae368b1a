"""Sources (S1-S3, S8, S9), snapshot merge (U2) and union."""

import json
import os
import tempfile

import pytest
from pyspark.sql import types as T

from evalloop.operators import merge as mg
from evalloop.sources import io
from evalloop.sources.parts import PartLists

SCHEMA = T.StructType([T.StructField("_judge_key", T.StringType()), T.StructField("v", T.LongType())])


def test_keyed_jsonl_last_wins(spark):
    from evalloop.operators.judge import last_wins
    d = tempfile.mkdtemp(prefix="evalloop-jsonl-")
    with open(os.path.join(d, "log.jsonl"), "w") as f:
        f.write('{"_judge_key": "a", "v": 1}\n\n{bad json\n[1,2]\n{"v": 3}\n{"_judge_key": "a", "v": 2}\n'
                '{"_judge_key": "b", "v": 5}\n')
    df = io.read_keyed_jsonl(spark, d, SCHEMA, "_judge_key")
    got = {r._judge_key: r.v for r in last_wins(df, "_judge_key", "ingest_seq").collect()}
    assert got == {"a": 2, "b": 5}


def test_values_of_another_type_keep_their_row(spark):
    d = tempfile.mkdtemp(prefix="evalloop-jsonl-")
    with open(os.path.join(d, "log.jsonl"), "w") as f:
        f.write('{"_judge_key": "a", "v": "x"}\n{"_judge_key": "b", "v": 1.5}\n{"_judge_key": "c", "v": 3}\n{"_judge_key": "d", "v": \n'
                '"text"\n7\n{"_judge_key": "", "v": 1}\n{"_judge_key": null}\n')
    rows = {r._judge_key: r for r in io.read_keyed_jsonl(spark, d, SCHEMA, "_judge_key").collect()}
    assert {k: r.v for k, r in rows.items()} == {"a": None, "b": None, "c": 3}
    assert '"x"' in rows["a"][io.CORRUPT] and rows["c"][io.CORRUPT] is None
    assert io.read_json_or_jsonl(spark, d, SCHEMA).filter("_judge_key is not null").count() == 4


def test_array_and_auto_reader(spark):
    d = tempfile.mkdtemp(prefix="evalloop-json-")
    arr = os.path.join(d, "a.json")
    with open(arr, "w") as f:
        json.dump([{"_judge_key": "x", "v": 1}, {"_judge_key": "y", "v": 2}], f, indent=2)
    assert io.read_json_array(spark, arr, SCHEMA).count() == 2
    assert [f.rsplit("/", 1)[1] for f in io.array_files(spark, arr)[0]] == ["a.json"]
    assert io.read_json_or_jsonl(spark, arr, SCHEMA).count() == 2
    lines = os.path.join(d, "b.jsonl")
    with open(lines, "w") as f:
        f.write('{"_judge_key": "x", "v": 1}\nnot json\n')
    assert io.array_files(spark, lines)[0] == []
    assert io.read_json_or_jsonl(spark, lines, SCHEMA).count() == 1
    assert io.read_json_or_jsonl(spark, d, SCHEMA).count() == 3  # each file by its own first character


def test_seed_or_empty(spark):
    df = io.seed_or_empty(spark, "/nonexistent/evalloop", SCHEMA)
    assert df.count() == 0 and df.schema == SCHEMA


def test_manifest_upsert(spark):
    m = spark.createDataFrame([("d", "f1", 1)], "dataset_name string, file_name string, version int")
    e = spark.createDataFrame([("d", "f2", 2), ("e", "g", 1)], "dataset_name string, file_name string, version int")
    got = {r.dataset_name: r.file_name for r in io.upsert_manifest(m, e).collect()}
    assert got == {"d": "f2", "e": "g"}


def test_snapshot_merge(spark):
    root = tempfile.mkdtemp(prefix="evalloop-train-")
    a = spark.createDataFrame([("q1", "", "o1")], "instruction string, input string, output string")
    b = spark.createDataFrame([("q2", "", "o2"), ("q3", "", "o3")], "instruction string, input string, output string")
    rows = lambda v: [r.instruction for r in mg.read_snapshot(spark, root, v).collect()]
    assert mg.merge_training_snapshot(spark, root, 0, a) == 1
    assert mg.merge_training_snapshot(spark, root, 1, b) == 2
    assert sorted(rows(1)) == ["q1", "q2", "q3"] and rows(0) == ["q1"]  # merge count = sum
    with pytest.raises(FileExistsError):
        mg.merge_training_snapshot(spark, root, 1, b)
    with pytest.raises(FileNotFoundError):  # snapshot 2 is missing
        mg.merge_training_snapshot(spark, root, 3, b)
    lists = PartLists(spark, root)
    os.remove(lists._list(1))  # a write that did not end: no predecessor, and written anew
    with pytest.raises(FileNotFoundError):
        mg.merge_training_snapshot(spark, root, 2, b)
    with pytest.raises(FileNotFoundError):
        mg.read_snapshot(spark, root, 1)
    mg.merge_training_snapshot(spark, root, 1, b)
    assert sorted(rows(1)) == ["q1", "q2", "q3"]


def test_a_round_writes_its_new_rows_only_and_the_order_is_that_of_the_parts(spark):
    root = tempfile.mkdtemp(prefix="evalloop-train-")
    row = lambda *names: spark.createDataFrame([(n, "t " + n) for n in names], "instruction string, output string")
    for v, names in enumerate([("s1", "s2"), ("a1",), (), ("b1", "b2", "b3")]):
        written = mg.merge_training_snapshot(spark, root, v, row(*names) if names else row("x").limit(0))
        assert written == len(names)
    lists = PartLists(spark, root)
    assert [p["rows"] for p in lists.read(3)["parts"]] == [2, 1, 0, 3] and len(set(lists.paths(lists.read(3)))) == 4
    got = mg.read_snapshot(spark, root, 3, order_col="part").orderBy("part", "instruction").collect()
    assert [(r.part, r.instruction) for r in got] == [(0, "s1"), (0, "s2"), (1, "a1"), (3, "b1"), (3, "b2"), (3, "b3")]
    assert mg.read_snapshot(spark, root, 1).count() == 3  # older versions stay as they were
    # Shuffled or deduplicated versions are one new part, as rows of all parts change place or go.
    mg.merge_training_snapshot(spark, root, 4, row("c1"), shuffle_seed=1)
    assert len(lists.read(4)["parts"]) == 1 and mg.read_snapshot(spark, root, 4).count() == 7
    extra = spark.createDataFrame([("d1", "t d1", 5)], "instruction string, output string, level int")
    mg.merge_training_snapshot(spark, root, 5, extra)  # a column that older parts lack is null there
    wide = {r.instruction: r.level for r in mg.read_snapshot(spark, root, 5).collect()}
    assert wide["d1"] == 5 and wide["s1"] is None and len(wide) == 8


def test_union_datasets(spark):
    a = spark.createDataFrame([(1, "x")], "id long, problem string")
    b = spark.createDataFrame([(2, "y")], "id long, question string")
    u = mg.union_datasets([a, b])
    assert set(u.columns) == {"id", "problem", "question"} and u.count() == 2


def test_stored_tables_are_released(spark):
    from evalloop.session import cut_lineage, path_exists, release_tables, tables_root

    root = tables_root(spark)
    assert cut_lineage(spark.range(3), "t").count() == 3 and path_exists(spark, root)
    release_tables(spark)
    assert not path_exists(spark, root)
    assert cut_lineage(spark.range(4), "t").count() == 4


def test_a_cluster_must_name_its_checkpoint_folder(monkeypatch):
    from types import SimpleNamespace

    from evalloop.session import ensure_checkpoint_dir

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(cluster)


def test_lines_that_are_one_whole_object_and_nothing_else(spark):
    d = tempfile.mkdtemp(prefix="evalloop-jsonl-")
    good = ['\t{"_judge_key": "tab", "v": 1}', '{"_judge_key": "old", "v": 1, "_judge_key": "twice", "v": 2}', '{"_judge_key": "nan", "v": NaN}',
            '{"_judge_key": "inf", "v": -Infinity}', '\u3000{"_judge_key": "wide blank", "v": 3}\u00a0', '{"_judge_key": "deep", "x": [{"y": {}}], "v": 4}']
    bad = ['{"_judge_key": "a", "v": 1} trailing', '{"_judge_key": "b", "v": 1},', '{"_judge_key": "c"}{"_judge_key": "d"}', "{'_judge_key': 'e'}",
           '{"_judge_key": "f", "v": 1', '[{"_judge_key": "g"}]', '"h"', '{"_judge_key": 01}']
    with open(os.path.join(d, "log.jsonl"), "w") as f:
        f.write("\n".join(good + bad))
    rows = {r._judge_key: r for r in io.read_keyed_jsonl(spark, d, SCHEMA, "_judge_key").collect()}
    assert {k: r.v for k, r in rows.items()} == {"tab": 1, "twice": 2, "nan": None, "inf": None, "wide blank": 3, "deep": 4}
    assert rows["nan"][io.CORRUPT] == good[2] and rows["tab"][io.CORRUPT] is None


def test_array_reader_rejects_other_files(spark):
    d = tempfile.mkdtemp(prefix="evalloop-json-")
    for name, text in (("a.json", '\t\n [{"v": 1}]'), ("b.json", '{"v": 2}')):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    assert io.read_json_array(spark, os.path.join(d, "a.json"), SCHEMA).count() == 1
    with pytest.raises(ValueError, match="b.json"):
        io.read_json_array(spark, d, SCHEMA)


def test_rows_are_derived_once_before_they_are_placed(spark):
    """The plan that places merged rows reads a stored table, not what the rows come from."""
    from evalloop.operators import merge as mg

    parts = [spark.range(5).selectExpr("id AS k", "upper(concat('text ', id)) AS t"), None, spark.range(3).selectExpr("id AS k", "'x' AS t")]
    out = mg.merge_rows(parts, order_cols=["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan and "upper" not in plan
    assert sorted((r.part_idx, r.part_row, r.k) for r in out.collect()) == [(0, i, i) for i in range(5)] + [(2, i, i) for i in range(3)]
