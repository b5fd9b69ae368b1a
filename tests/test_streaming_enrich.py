"""Incremental judge (I1-I3) and enrichment jobs (E1-E5) with stand-in models."""

import tempfile

import pytest
from pyspark.sql import functions as F

from evalloop.operators import enrich as en
from evalloop.operators import metrics as mt
from evalloop.sources.parts import PartLists
from evalloop.streaming import incremental as inc


def test_incremental_replacement_and_no_double_count(spark):
    root = tempfile.mkdtemp(prefix="evalloop-stream-")
    problems = spark.createDataFrame([("q1", "d", "\\boxed{1}"), ("q2", "d", "\\boxed{2}")],
                                     "judge_key string, dataset string, answer string")
    spark.createDataFrame([("q1", 0, "\\boxed{0}"), ("q2", 0, "\\boxed{2}")], inc.CANDIDATE_SCHEMA) \
        .write.parquet(f"{root}/in/a")
    q = inc.start_incremental_judge(spark, f"{root}/in/*", problems, f"{root}/store", f"{root}/ckpt", k=2)
    q.awaitTermination()
    first = {r.judge_key: r.pass_at_k for r in inc.current_verdicts(spark, f"{root}/store").collect()}
    assert first == {"q1": False, "q2": True}
    # a later drop adds a correct second candidate for q1; a restart must not re-count drop a
    spark.createDataFrame([("q1", 1, "\\boxed{1}")], inc.CANDIDATE_SCHEMA).write.parquet(f"{root}/in/b")
    q = inc.start_incremental_judge(spark, f"{root}/in/*", problems, f"{root}/store", f"{root}/ckpt", k=2)
    q.awaitTermination()
    cur = {r.judge_key: (r.pass_at_k, r.n_candidates) for r in inc.current_verdicts(spark, f"{root}/store").collect()}
    assert cur == {"q1": (True, 2), "q2": (True, 1)}
    stats = {r.scope: r.n for r in inc.running_stats(spark, f"{root}/store").collect()}
    assert stats["overall"] == 2


def run_stream(spark, root, problems, **options):
    q = inc.start_incremental_judge(spark, f"{root}/in/*", problems, f"{root}/store", f"{root}/ckpt", k=2, **options)
    q.awaitTermination()
    return q


def test_state_is_one_row_per_question_and_totals_follow_replacements(spark):
    """Six micro-batches of one file each: re-deliveries, late correct answers, candidates without number or key."""
    root = tempfile.mkdtemp(prefix="evalloop-stream-")
    problems = spark.createDataFrame([(f"q{k}", f"d{k % 2}" if k else None, f"\\boxed{{{k}}}") for k in range(5)] + [("none", "d0", None)],
                                     "judge_key string, dataset string, answer string")
    right = lambda k, i: (f"q{k}", i, f"\\boxed{{{k}}}")
    wrong = lambda k, i: (f"q{k}", i, "\\boxed{99}")
    drops = [[wrong(k, 0) for k in range(5)] + [("none", 0, "x"), ("stranger", 0, "x"), (None, 0, "x")],
             [right(0, 1), right(1, 40), wrong(2, 70_000)],
             [right(2, 0), right(2, 1), right(2, 1)],  # number 0 was delivered wrong: the first delivery counts
             [wrong(0, 1), right(3, 5), right(4, -1), ("q3", None, "\\boxed{3}"), ("q3", None, "\\boxed{3}")],
             [right(0, 1), wrong(2, 0)],  # nothing new at all
             [right(3, 1), wrong(3, 2)]]
    store = inc.VerdictStore(spark, f"{root}/store")
    for n, drop in enumerate(drops):
        spark.createDataFrame(drop, inc.CANDIDATE_SCHEMA).coalesce(1).write.parquet(f"{root}/in/{n}")
        if n in (1, 5):  # the first run has two batches, the restart four
            q = run_stream(spark, root, problems, files_per_batch=1, fan_in=2)
    assert [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1] == 6
    got = {r.judge_key: (r.n_candidates, r.pass_at_1, r.pass_at_k) for r in inc.current_verdicts(spark, f"{root}/store").collect()}
    assert got == {"q0": (2, False, True), "q1": (2, False, False), "q2": (3, False, True), "q3": (5, False, True),
                   "q4": (2, False, True), "none": (1, False, False)}
    now = store.lists.read()
    assert now["batch"] >= 4 and len(now["parts"]) <= 3 and len({p["level"] for p in now["parts"]}) == len(now["parts"])
    assert len(store.lists.versions()) == 3  # older lists and what only they name are gone
    full = sorted(map(tuple, mt.stats_rollup(inc.current_verdicts(spark, f"{root}/store")).collect()), key=repr)
    assert sorted(map(tuple, inc.running_stats(spark, f"{root}/store").collect()), key=repr) == full
    # A batch that comes again after its list was committed changes nothing.
    again = spark.createDataFrame([("q1", "d1", 9, True, True, 2, False, False)], inc.CHANGES)
    store.add(again, now["batch"], 2)
    assert store.lists.read() == now
    with pytest.raises(ValueError):
        inc.start_incremental_judge(spark, f"{root}/in/*", problems, f"{root}/store", f"{root}/other", k=2)


def test_part_lists_commit_once_and_readers_see_whole_lists(spark):
    lists = PartLists(spark, tempfile.mkdtemp(prefix="evalloop-parts-"))
    assert lists.read() is None and lists.versions() == [] and lists.read(3) is None
    for v in range(4):
        spark.range(v).write.parquet(f"{lists.root}/p{v}")
        lists.commit(v, {"parts": [{"path": f"p{i}"} for i in range(max(0, v - 1), v + 1)]})
    with pytest.raises(FileExistsError):
        lists.commit(3, {"parts": []})
    assert [p[len(lists.root):] for p in lists.paths(lists.read())] == ["/p2", "/p3"]
    lists.forget(2, lambda c: [p["path"] for p in c["parts"]])
    assert lists.versions() == [2, 3]
    assert spark.read.parquet(*lists.paths(lists.read(2))).count() == 3  # p1 and p2 are still named
    with pytest.raises(Exception):
        spark.read.parquet(f"{lists.root}/p0")


def test_complete_retries_and_errors(spark):
    calls = {"n": 0}

    def flaky(system, user, params):
        if user == "boom":
            raise ValueError("bad request")
        return f"{user}!{params['cand_idx']}"

    prompts = spark.createDataFrame([("a", "s", "hi"), ("b", "s", "boom")], "key string, system_prompt string, user_prompt string")
    out = {r.key: r for r in en.complete(en.expand_samples(prompts, 2), flaky, ["key"], retries=2, base_sleep=0.0).collect()
           if r.cand_idx == 1}
    assert out["a"].text == "hi!1" and out["a"].error is None and out["a"].attempts == 1
    assert out["b"].text is None and "bad request" in out["b"].error and out["b"].attempts == 3
    del calls


def test_parse_attribution(spark):
    df = spark.createDataFrame([('{"error_type": "x", "reason": "r"}',), ("no json",), ("{}",)], "text string")
    rows = en.parse_attribution(df).collect()
    assert rows[0].error_type == "x" and rows[0].raw_text is None
    assert rows[1].raw_text == "no json" and rows[2].raw_text == "{}"


def test_attribution_keeps_cases_whose_call_failed(spark):
    def model(system, user, params):
        if "Q2" in user:
            raise ValueError("refused")
        return '{"error_type": "x"}' if "Q1" in user else user[:0] + "no object"

    bad = spark.createDataFrame([("a", "Q1", "1"), ("b", "Q2", "2"), ("c", " ", "3")], "judge_key string, question string, answer string")
    cands = spark.createDataFrame([("a", 0, "p"), ("c", 0, "q")], "judge_key string, cand_idx int, text string")
    rows = {r.judge_key: r for r in en.attribution_job(bad, cands, model, retries=1, base_sleep=0.0).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"].error_type == "x" and rows["a"].error is None
    assert rows["b"].error == "ValueError: refused" and rows["b"].raw_text is None and rows["b"].attempts == 2
    assert rows["c"].raw_text == "no object" and '"answer":"3"' in rows["c"].question  # Q10: the row stands in for a blank question
    out = en.attribution_job(bad, cands, model, retries=0, base_sleep=0.0)
    assert [r.judge_key for r in en.failed_calls(out).collect()] == ["b"]
    made = en.generation_job(out, lambda s, u, p: "", base_sleep=0.0, max_attempts=1).collect()
    assert sorted(r.judge_key for r in made) == ["a", "c"] and not any(r.accepted for r in made)


def test_questions_cost_no_python_and_both_states_give_the_same_changes(spark, monkeypatch):
    """The aggregation's plan holds no Python, and its verdicts equal those of ``transformWithState`` on contradicting re-deliveries."""
    import random

    rng = random.Random(3)
    problems = spark.createDataFrame([(f"q{j}", f"d{j % 2}", "\\boxed{1}") for j in range(12)], "judge_key string, dataset string, answer string")
    roots = [tempfile.mkdtemp(prefix="evalloop-stream-") for _ in range(2)]
    for n in range(3):
        drop = [(f"q{rng.randint(0, 11)}", rng.choice([None, -2, -1, 0, 1, 2, 40]), f"\\boxed{{{rng.randint(1, 2)}}}") for _ in range(30)]
        for root in roots:
            spark.createDataFrame(drop, inc.CANDIDATE_SCHEMA).coalesce(1).write.parquet(f"{root}/in/{n}")
    got = []
    for root, most in zip(roots, (64, 0)):
        monkeypatch.setattr(inc, "MOST_COLUMNS", most)
        run_stream(spark, root, problems, files_per_batch=1)
        got.append([sorted(map(tuple, x.collect()), key=repr) for x in (inc.current_verdicts(spark, f"{root}/store"), inc.running_stats(spark, f"{root}/store"))])
    assert got[0] == got[1] and len(got[0][0]) == 12
    marks = spark.createDataFrame([("q", "d", 0, True, 5)], "judge_key string, dataset string, number long, ok boolean, at long")
    changes = inc.verdict_changes(marks, 2)
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    assert [tuple(r) for r in changes.collect()] == [("q", "d", 1, True, True, None, None, None)]


def test_calls_are_in_flight_together_and_keep_their_rows(spark):
    """As many calls at a time as asked, whatever one of them waits for; no future per row."""
    import inspect

    def model(system, user, params):
        import threading
        import time
        time.sleep(0.2 if user == "0" else 0.01)
        if user == "5":
            raise ValueError("no")
        return f" {user} on {threading.current_thread().name}"

    prompts = spark.range(40).coalesce(1).select(F.col("id").alias("k"), F.lit("s").alias("system_prompt"), F.col("id").cast("string").alias("user_prompt"))
    got = {r.k: r for r in en.complete(prompts, model, ["k"], retries=1, base_sleep=0.0, threads=4).collect()}
    assert len(got) == 40 and all(r.text.split()[0] == str(k) and r.attempts == 1 for k, r in got.items() if k != 5)
    assert (got[5].text, got[5].error, got[5].attempts) == (None, "ValueError: no", 2)
    assert len({r.text.split(" on ")[1] for k, r in got.items() if k != 5}) == 4
    assert "_asdict" not in inspect.getsource(en.complete)
