"""Judging, pass@k, statistics, bad cases, resume and last-wins (golden rows, FIXTURES.md §3)."""

import re

from pyspark.sql import functions as F

from evalloop.operators import judge as jd
from evalloop.operators import metrics as mt


def _problems(spark, rows):
    return spark.createDataFrame(rows, "judge_key string, dataset string, answer string")


def _cands(spark, rows):
    return spark.createDataFrame(rows, "judge_key string, cand_idx int, text string")


def test_pass_at_k_wrong_right_wrong(spark):
    p = _problems(spark, [("q", "d", "\\boxed{5}")])
    c = _cands(spark, [("q", 0, "\\boxed{4}"), ("q", 1, "\\boxed{5}"), ("q", 2, "\\boxed{6}")])
    pq = jd.pass_at_k(jd.judge_candidates(p, c), [1, 2, 8])
    got = {r.k: (r.pass_at_1, r.pass_at_k, r.n_candidates) for r in pq.collect()}
    assert got == {1: (False, False, 3), 2: (False, True, 3), 8: (False, True, 3)}


def test_empty_candidates_and_null_gold(spark):
    p = _problems(spark, [("a", "d", "\\boxed{1}"), ("b", "d", None)])
    c = _cands(spark, [("b", 0, "")])
    v = {r.judge_key: r for r in jd.judge_candidates(p, c).collect()}
    assert v["a"].cand_idx == 0 and v["a"].pred_final == "" and not v["a"].final_correct
    assert v["b"].gold_missing and not v["b"].final_correct
    pq = {r.judge_key: r for r in jd.pass_at_k(jd.judge_candidates(p, c), [1]).collect()}
    assert pq["a"].n_candidates == 1 and not pq["a"].pass_at_k


def test_both_empty_is_not_correct(spark):
    p = _problems(spark, [("a", "d", "")])
    c = _cands(spark, [("a", 0, "")])
    assert not jd.judge_candidates(p, c).first().final_correct


def test_per_dataset_ratio_not_doubled_for_k1(spark):
    """All correct, k = 1 -> 1.0 per dataset."""
    p = _problems(spark, [("a", "d1", "\\boxed{1}"), ("b", "d1", "\\boxed{2}")])
    c = _cands(spark, [("a", 0, "\\boxed{1}"), ("b", 0, "\\boxed{2}")])
    stats = mt.stats_rollup(jd.pass_at_k(jd.judge_candidates(p, c, keep=["dataset"]), [1], carry=["dataset"]))
    rows = {(r.scope, r.dataset): r for r in stats.collect()}
    assert rows[("dataset", "d1")].pass_at_1 == 1.0 and rows[("dataset", "d1")].pass_at_k == 1.0
    assert rows[("overall", None)].n == 2


def test_bad_case_uses_own_k(spark):
    """A row judged with k = 4 that passed is not a bad case under a run with k = 8."""
    pq = spark.createDataFrame([("a", 4, True), ("b", 8, False), ("c", 8, None)],
                               "judge_key string, k int, pass_at_k boolean")
    assert sorted(r.judge_key for r in jd.bad_cases(pq).collect()) == ["b", "c"]


def test_last_wins_and_restrict(spark):
    log = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 5)], "judge_key string, seq int, v int")
    got = {r.judge_key: r.v for r in jd.last_wins(log, "judge_key", "seq").collect()}
    assert got == {"a": 2, "b": 5}
    current = spark.createDataFrame([("a",)], "judge_key string")
    kept = jd.restrict_to_current(jd.last_wins(log, "judge_key", "seq"), current)  # D7
    assert [r.judge_key for r in kept.collect()] == ["a"]


def test_resume_anti_join(spark):
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "judge_key string")
    done = spark.createDataFrame([("b",)], "judge_key string")
    assert sorted(r.judge_key for r in jd.resume(todo, done).collect()) == ["a", "c"]


def test_harmonise_prediction_shapes(spark):
    df = spark.createDataFrame([([{"output": "x"}, None],), ([],)],
                               "predictions array<struct<output:string,final_answer:string>>")
    got = [r.p for r in df.select(jd.harmonise_predictions(df).alias("p")).collect()]
    assert got == [["x", ""], [""]]
    df2 = spark.createDataFrame([("p",), ("",)], "prediction string")
    assert [r.p for r in df2.select(jd.harmonise_predictions(df2).alias("p")).collect()] == [["p"], [""]]
    att = [r.p for r in df.select(jd.harmonise_predictions(df, for_judging=False).alias("p")).collect()]
    assert att == [["x"], []]
    odd = spark.createDataFrame([([{"output": 7}],)], "predictions array<struct<output:int>>")  # only text is an answer
    assert odd.select(jd.harmonise_predictions(odd).alias("p")).first().p == [""]
    assert odd.select(jd.harmonise_predictions(odd, for_judging=False).alias("p")).first().p == []
    flat = spark.createDataFrame([([1.5, 2.0],)], "predictions array<double>")
    assert flat.select(jd.harmonise_predictions(flat).alias("p")).first().p == ["", ""]




def test_judge_key_rule(spark):
    df = spark.createDataFrame([("id/x", "n", 3), ("", "n", 4), ("", "", 5)],
                               "dataset_id string, dataset string, sample_index long")
    assert [r.k for r in df.select(jd.judge_key().alias("k")).collect()] == ["id/x::3", "n::4", "::5"]


def test_array_form_equals_long_form(spark):
    p = spark.createDataFrame([("q", "d", "\\boxed{5}", ["\\boxed{4}", "#### 5", "5"])],
                              "judge_key string, dataset string, answer string, predictions array<string>")
    r = jd.judge_arrays(p, 2).first()
    assert (r.n_candidates, r.pass_at_1, r.pass_at_k) == (3, False, True)


def test_compare_golden(spark):
    """a = {count 4, pass@1 .5}, b = {pass@1 .75, pass@8 .9}."""
    a = spark.createDataFrame([("count", 4.0), ("pass@1", 0.5)], "metric string, value double")
    b = spark.createDataFrame([("pass@1", 0.75), ("pass@8", 0.9)], "metric string, value double")
    got = {r.metric: (r.iter_a, r.iter_b, r.delta) for r in mt.compare(a, b).collect()}
    assert got == {"count": (4.0, None, None), "pass@1": (0.5, 0.75, 0.25), "pass@8": (None, 0.9, None)}


def test_round_history(spark):
    m = spark.createDataFrame([("r", 0, "pass@1", 0.5), ("r", 1, "pass@1", 0.75)],
                              "run_name string, iter int, metric string, value double")
    rows = sorted(mt.round_history(m).collect(), key=lambda r: r.iter)
    assert rows[0].prev_value is None and rows[1].delta == 0.25


def test_overall_summary_empty(spark):
    empty = spark.createDataFrame([], "k int, pass_at_1 boolean, pass_at_k boolean")
    r = mt.overall_summary(empty).first()
    assert (r["count"], r.pass_at_1, r.pass_at_k) == (0, 0.0, 0.0)


def test_judged_only_and_row_count(spark, tmp_path):
    rows = spark.createDataFrame([("a", True), ("b", None)], "judge_key string, pass_at_k boolean")
    assert [r.judge_key for r in jd.judged_only(rows).collect()] == ["a"]
    p = str(tmp_path / "t")
    rows.write.parquet(p)
    assert mt.row_count(spark, p) == 2 and mt.row_count(spark, str(tmp_path / "missing")) == 0


def test_hot_question_with_skew_split(spark):
    """One question holds a third of all candidates; AQE may split it: results stay exact."""
    hot = [("hot", i, "\\boxed{7}" if i == 5 else "\\boxed{1}") for i in range(600)]
    cold = [(f"q{j}", i, f"\\boxed{{{j % 3}}}") for j in range(300) for i in range(4)]
    p = _problems(spark, [("hot", "d", "\\boxed{7}")] + [(f"q{j}", "e", "\\boxed{0}") for j in range(300)]
                  + [("none", "e", "\\boxed{0}")])
    c = _cands(spark, hot + cold)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                            "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.judge_key, r.k): (r.n_candidates, r.pass_at_1, r.pass_at_k)
               for r in jd.pass_at_k(jd.judge_candidates(p, c), [1, 8]).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got[("hot", 1)] == (600, False, False) and got[("hot", 8)] == (600, False, True)
    assert got[("q0", 1)] == (4, True, True) and got[("q1", 8)] == (4, False, False)
    assert got[("none", 8)] == (1, False, False)
    assert len(got) == 2 * 302


def test_log_key_rebuilds_missing(spark):
    log = spark.createDataFrame([("k1", "ds", "d", 1, 0), (None, "ds", "d", 2, 1), ("", "", "d", 3, 2),
                                 ("k1", "ds", "d", 1, 3)],
                                "_judge_key string, dataset_id string, dataset string, sample_index long, seq int")
    keyed = log.withColumn("k", jd.log_key(log))
    got = {r.k: r.seq for r in jd.last_wins(keyed.drop("_judge_key"), "k", "seq").collect()}
    assert got == {"k1": 3, "ds::2": 1, "d::3": 2}


def test_counts_per_answer_give_the_same_rows(spark):
    """The one-pass form equals judging every candidate, with a hot question, null gold and questions without output."""
    import random

    rng = random.Random(5)
    p = _problems(spark, [("hot", "d", "\\boxed{7}"), ("none", "d", "\\boxed{1}"), ("nogold", "e", None), ("blank", "e", "")]
                  + [(f"q{j}", rng.choice("de"), f"\\boxed{{{j % 4}}}") for j in range(80)])
    c = _cands(spark, [("hot", i, f"\\boxed{{{rng.randint(0, 9)}}}") for i in range(400)] + [("nogold", 0, "x"), ("blank", 0, ""), ("other", 0, "x")]
               + [(f"q{j}", i, rng.choice(["", f"\\boxed{{{rng.randint(0, 4)}}}", "#### 2"])) for j in range(80) for i in range(rng.randint(0, 5))])
    want = jd.pass_at_k(jd.judge_candidates(p, c, keep=["dataset"]), [1, 2, 8], carry=["dataset"])
    got = jd.pass_at_k_from_candidates(p, c, [1, 2, 8], carry=["dataset"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_question_is_counted_before_it_is_shuffled(spark):
    """The exchange below the per-answer counts carries partial counts, and the candidates are read once."""
    import contextlib
    import io as stdio

    from pyspark.sql import functions as F

    p = _problems(spark, [(f"q{j}", "d", "\\boxed{1}") for j in range(50)])
    c = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, "q0").otherwise(F.concat(F.lit("q"), (F.col("id") % 50).cast("string"))).alias("judge_key"),
                                    (F.col("id") % 64).cast("int").alias("cand_idx"), F.concat(F.lit("#### "), (F.col("id") % 7).cast("string")).alias("text"))
    out = stdio.StringIO()
    df = jd.pass_at_k_from_candidates(p, c, [1, 8], carry=["dataset"])
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    text = out.getvalue()
    assert text.split("== Physical Plan ==")[1].split("\n\n\n")[0].count("Range (") == 1
    assert "partial_count" in text and "SortAggregate" not in text
    assert df.filter("judge_key = 'q0' and k = 8").first().n_candidates > 33_000


def test_arrays_extract_the_gold_once_per_question(spark):
    """a candidate meets the gold answer as a bound value, not as an expression over the answer's text."""
    p = spark.createDataFrame([("\\boxed{5}", ["#### 5", "\\boxed{\\frac{1}{2}}"]), (None, ["5"]), ("5", [])],
                              "answer string, predictions array<string>")
    rows = jd.judge_arrays(p, 2)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"= lambda \w+#\d+\)\) AND isnotnull\(answer#", plan)
    assert [(r.n_candidates, r.pass_at_1, r.pass_at_k) for r in rows.collect()] == [(2, True, True), (1, False, False), (1, False, False)]
