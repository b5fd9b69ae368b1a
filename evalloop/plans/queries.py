"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the given tables (through :mod:`evalloop.sources.fixtures`)
in full; column names equal those of the matching SQL in
:mod:`evalloop.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloop.functions import text as tx
from evalloop.operators import enrich as en
from evalloop.operators import judge as jd
from evalloop.operators import merge as mg
from evalloop.operators import metrics as mt
from evalloop.operators import prompts as pr
from evalloop.operators import sampling as sm
from evalloop.operators import shaping as sh
from evalloop.operators import similarity as si
from evalloop.operators import synth as sy
from evalloop.operators import validate as va
from evalloop.sources import fixtures as fx

KS = (1, 3, 8)
DEFAULT_K = 8


# ---------------------------------------------------------------------------
# Evaluation: extraction, judging, pass@k, statistics
# ---------------------------------------------------------------------------
def final_answer_extract(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.candidates(spark, sf)
    return c.select("sample_index", "cand_idx", tx.final_answer("text").alias("pred_final"))


def answer_normalise(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.candidates(spark, sf)
    return c.select("sample_index", "cand_idx",
                    tx.normalize_answer(tx.final_answer("text")).alias("pred_norm"))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    gold = fx.gold_problems(spark, sf)
    return jd.judge_candidates(gold, fx.candidates(spark, sf), key="sample_index",
                               keep=["judge_key", "dataset"])


def judge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).select("judge_key", "cand_idx", "pred_final", "gt_final", "final_correct")


def per_question(spark: SparkSession, sf: str, ks=KS) -> DataFrame:
    return jd.pass_at_k_from_candidates(fx.gold_problems(spark, sf), fx.candidates(spark, sf), ks, key="sample_index",
                                        carry=["judge_key", "dataset"])


def pass_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return per_question(spark, sf).select("judge_key", "dataset", "k", "n_candidates", "pass_at_1", "pass_at_k")


def stats_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return mt.stats_rollup(per_question(spark, sf))


def bad_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Judged on keys only; question and answer texts join back to the failing rows."""
    gold = fx.gold_problems(spark, sf)
    pq = jd.pass_at_k_from_candidates(gold, fx.candidates(spark, sf), [DEFAULT_K], key="sample_index",
                                      carry=["judge_key", "dataset"])
    return jd.bad_cases(pq, gold, key="sample_index", cols=("question", "answer")).select(
        "judge_key", "dataset", "sample_index", "question", "answer", "n_candidates")


def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """N1 + U3 + J5: odd orders were judged by an earlier run; judge the rest, merge, last wins."""
    gold = fx.gold_problems(spark, sf)
    cands = fx.candidates(spark, sf)

    def run(problems, seq):
        return jd.pass_at_k_from_candidates(problems, cands, [DEFAULT_K], key="sample_index", carry=["judge_key"]).withColumn(
            "ingest_seq", F.lit(seq))

    done = run(gold.filter(F.col("sample_index") % 2 == 1), 0).withColumn("resumed", F.lit(True))
    todo = jd.resume(gold, done, key="sample_index")
    fresh = run(todo, 1).withColumn("resumed", F.lit(False))
    merged = jd.last_wins(done.unionByName(fresh), "judge_key", "ingest_seq")
    return merged.select("judge_key", "n_candidates", "pass_at_1", "pass_at_k", "resumed")


def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """J5 on the event log: the latest event per user by (ts, event_id)."""
    ev = fx.read_table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    latest = jd.last_wins(ev, "user_id", ["ts", "event_id"])
    return latest.select("user_id", "event_id", "event_type", "value")


def _summary_metrics(pq: DataFrame, k: int) -> DataFrame:
    return mt.metric_table(mt.overall_summary(pq.filter(F.col("k") == k)))


def compare_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Round a judged with k = 1, round b with k = 8."""
    pq = per_question(spark, sf)
    return mt.compare(_summary_metrics(pq, 1), _summary_metrics(pq, 8))


def round_history(spark: SparkSession, sf: str) -> DataFrame:
    """R2: rounds = k in (1, 2, 4, 8); metric series with previous value and change."""
    pq = per_question(spark, sf, ks=(1, 2, 4, 8))
    rounds = pq.groupBy("k").agg(
        F.count(F.lit(1)).cast("double").alias("count"),
        (F.sum(F.col("pass_at_1").cast("int")) / F.count(F.lit(1))).alias("pass@1"),
        (F.sum(F.col("pass_at_k").cast("int")) / F.count(F.lit(1))).alias("pass@k"))
    long = rounds.select(F.lit("fixture").alias("run_name"), F.col("k").alias("iter"), F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in ("count", "pass@1", "pass@k")]
    )).alias("x")).select("run_name", "iter", "x.metric", "x.value")
    return mt.round_history(long)


# ---------------------------------------------------------------------------
# Shaping, sampling, counts
# ---------------------------------------------------------------------------
def dataset_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.read_table(spark, sf, "documents").select(F.col("source").alias("dataset"))
    return mt.dataset_counts(docs)


def seeded_order(col: str, seed: int = 42):
    """Integer hash usable by both engines (Lehmer step), for seeded sampling."""
    return (F.col(col) * 48271 + seed) % 2147483647


def benchmark_build(spark: SparkSession, sf: str) -> DataFrame:
    """Problems table from heterogeneous raw rows."""
    raw = fx.doc_problems(spark, sf)
    return sh.benchmark_rows(raw, F.col("source"), F.concat(F.lit("docs/"), F.col("source")),
                             order_cols=["doc_id"])


def training_build(spark: SparkSession, sf: str) -> DataFrame:
    """(user turn, next assistant turn) pairs as alpaca rows.

    The pair is an equi-join on (conv_id, turn + 1): no window over a whole
    conversation, so a huge conversation is not one task."""
    conv = fx.read_table(spark, sf, "conversations")
    users = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    bots = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    pairs = users.join(bots, ["conv_id", "turn"], "left")
    return sh.training_rows(pairs, keep=["conv_id", "turn"])


def sample_per_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """L3: 4 documents per source, seeded order."""
    docs = fx.read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset"))
    s = sm.sample_per_group(docs, "dataset", "doc_id", n=4, order=seeded_order("doc_id"))
    return s.select("dataset", "doc_id", F.col("sample_rank").cast("int").alias("sample_rank"))


def dataset_select(spark: SparkSession, sf: str) -> DataFrame:
    """U1 + L3 + L4 + P13: two fixed datasets and one dynamic one picked by seeded hash,
    4 rows each, tagged with provenance and a per-dataset index."""
    docs = fx.read_table(spark, sf, "documents").select("doc_id", "source")
    registry = spark.createDataFrame(
        [("src0", 0, "fixed", "hard"), ("src1", 1, "fixed", "hard"), ("src2", 2, "dynamic", "dynamic"),
         ("src3", 3, "dynamic", "dynamic"), ("src4", 4, "dynamic", "dynamic")],
        "source string, spec_idx int, kind string, difficulty string")
    dyn = registry.filter(F.col("kind") == "dynamic")
    pick = dyn.select(F.min_by("source", F.struct(seeded_order("spec_idx"), F.col("spec_idx"))).alias("source"))
    chosen = registry.filter(F.col("kind") == "fixed").select("source").unionByName(pick)
    # The registry is a handful of rows by construction: a bounded broadcast.
    spec = F.broadcast(registry.join(chosen, "source", "left_semi"))
    rows = docs.join(spec, "source")
    s = sm.sample_per_group(rows, "source", "doc_id", n=4, order=seeded_order("doc_id"))
    return s.select(F.col("source").alias("dataset"), F.concat(F.lit("docs/"), F.col("source")).alias("dataset_id"),
                    "difficulty", "doc_id", F.col("sample_rank").cast("long").alias("sample_index"))


def head_limit(spark: SparkSession, sf: str) -> DataFrame:
    """L1: the first 25 problems by input order (a top-k plan, no full sort)."""
    docs = fx.read_table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return sm.head_limit(docs, 25, ["doc_id"])


def strip_think(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.raw_responses(spark, sf)
    return r.select("doc_id", tx.strip_think("response").alias("cleaned"))


def unwrap_tags(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.raw_responses(spark, sf)
    return r.select("doc_id", tx.unwrap_tags("response").alias("unwrapped"))


def three_sections(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.raw_responses(spark, sf)
    return r.select("doc_id", tx.three_sections("response").alias("normalised"))


def qa_parse(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.raw_responses(spark, sf).select("doc_id", tx.qa_parse("response").alias("p"))
    return r.select("doc_id", F.col("p.question").alias("question"), F.col("p.answer").alias("answer"))


def synthetic_accept(spark: SparkSession, sf: str) -> DataFrame:
    r = sy.accept(fx.raw_responses(spark, sf))
    return r.select("doc_id", "accepted", "reject_reason", "instruction", "output")


def _attributions(spark: SparkSession, sf: str) -> DataFrame:
    return en.parse_attribution(fx.json_responses(spark, sf))


def tolerant_json(spark: SparkSession, sf: str) -> DataFrame:
    a = _attributions(spark, sf)
    return a.select("event_id", F.col("raw_text").isNull().alias("parsed"), "error_type", "missing_skill")


def error_profile(spark: SparkSession, sf: str) -> DataFrame:
    return mt.profile(_attributions(spark, sf), ["error_type", "missing_skill"])


def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.read_table(spark, sf, "documents").select("doc_id", "text")
    return si.near_duplicate_pairs(docs, "doc_id", "text")


def decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.read_table(spark, sf, "documents").select("doc_id", "text")
    bench = fx.benchmark_items(spark, sf)
    return si.cross_near_duplicates(docs, bench, "doc_id", "text", "item_id", "text")


def near_dup_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Component and number of links of every document that has an equal or near copy."""
    docs = fx.read_table(spark, sf, "documents").select("doc_id", "text")
    return si.near_duplicate_classes(docs, "doc_id", "text")


def decontaminate_links(spark: SparkSession, sf: str) -> DataFrame:
    """N6 (two tables): every document and every benchmark item that meet, with the number of links."""
    docs = fx.read_table(spark, sf, "documents").select("doc_id", "text")
    return si.cross_links(docs, fx.benchmark_items(spark, sf), "doc_id", "text", "item_id", "text")


def merge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """U4: documents without equal or near copies of a smaller id."""
    docs = fx.read_table(spark, sf, "documents").select("doc_id", "source", "text")
    return si.dedup(docs, "doc_id", "text").select("doc_id", "source")


def merge_training(spark: SparkSession, sf: str) -> DataFrame:
    """U2 plan: cumulative set = seed (conversation pairs) + accepted synthetic rows, in order."""
    seed = training_build(spark, sf).select("instruction", "input", "output", F.col("conv_id").alias("a"), F.col("turn").cast("long").alias("b"))
    synth_rows = synthetic_accept(spark, sf).filter("accepted").select(
        "instruction", F.lit("").alias("input"), "output", F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b"))
    return mg.merge_rows([seed, synth_rows], order_cols=["a", "b"]).select("part_idx", "part_row", "instruction", "input", "output")


def prompt_table(spark: SparkSession, sf: str) -> DataFrame:
    """Q1/Q4: inference prompts for every gold problem."""
    p = pr.prompt_table(fx.gold_problems(spark, sf), key="judge_key")
    text = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return p.select("judge_key", "user_prompt", "system_prompt", F.array_join(text, "\n").alias("messages"))


def training_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Q3: training-style user prompts for the conversation pairs."""
    rows = training_build(spark, sf)
    return rows.select("conv_id", "turn", pr.training_style_prompt(rows, "instruction").alias("user_prompt"))


def _bad_with_candidates(spark: SparkSession, sf: str):
    gold = fx.gold_problems(spark, sf)
    cands = fx.candidates(spark, sf)
    pq = jd.pass_at_k_from_candidates(gold, cands, [DEFAULT_K], key="sample_index", carry=["judge_key"])
    return jd.bad_cases(pq, gold, key="sample_index", cols=("question", "answer")), cands


def attribution_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Q6: one prompt per bad case with its failed predictions in candidate order."""
    bad, cands = _bad_with_candidates(spark, sf)
    cands = cands.join(bad.select("sample_index").distinct(), "sample_index", "left_semi")
    preds = sm.bounded_outputs(cands).groupBy("sample_index").agg(
        F.array_sort(F.collect_list(F.struct("cand_idx", "text"))).alias("_p"))
    rows = bad.join(preds, "sample_index", "left").withColumn(
        "predictions", F.transform(F.coalesce(F.col("_p"), F.array()), lambda s: s["text"]))
    return rows.select("judge_key", pr.attribution_prompt("question", "answer", "predictions").alias("user_prompt"))


def generation_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Q7: one generation prompt per parsed (or raw) attribution."""
    a = _attributions(spark, sf).withColumn("question", F.concat(F.lit("Problem of user "), F.col("user_id").cast("string")))
    return a.select("event_id", pr.generation_prompt("question", "error_type", "reason", "missing_skill",
                                                     "fix_suggestion", "raw_text").alias("user_prompt"))


def _validation_input(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.raw_responses(spark, sf)
    m = F.col("doc_id") % 3
    instr = (F.when(m == 0, F.col("source_question"))
             .when(m == 1, F.concat(F.lit(pr.TRAINING_USER_PREFIX + " "), F.col("source_question")))
             .otherwise(F.lit("short q")))
    return r.select(F.col("doc_id").alias("row_idx"), instr.alias("instruction"), F.col("response").alias("output"))


def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return va.validate_rows(_validation_input(spark, sf), mode="raw")


def validate_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _validation_input(spark, sf)
    return va.validate_summary(rows, va.validate_rows(rows, mode="raw"))


def judge_array_form(spark: SparkSession, sf: str) -> DataFrame:
    """P14 + P15 + J2 (array form): prediction rows, harmonised, judged without a shuffle."""
    gold = fx.gold_problems(spark, sf)
    comp = fx.candidates(spark, sf)
    rows = sh.prediction_rows(gold, comp, key="sample_index")
    rows = rows.withColumn("predictions", jd.harmonise_predictions(rows, "predictions"))
    j = jd.judge_arrays(rows, DEFAULT_K, "predictions")
    return j.select("judge_key", "n_candidates", "pass_at_1", "pass_at_k")


# ---------------------------------------------------------------------------
# Enrichment with stand-in models, streaming, loop
# ---------------------------------------------------------------------------
def _bad_for_jobs(spark: SparkSession, sf: str):
    bad, cands = _bad_with_candidates(spark, sf)
    return bad.select("sample_index", "judge_key", "question", "answer"), cands


def attribution_job(spark: SparkSession, sf: str) -> DataFrame:
    """Bad cases -> attribution prompts -> model -> tolerant parse."""
    from evalloop.plans import stubs
    bad, cands = _bad_for_jobs(spark, sf)
    out = en.attribution_job(bad, cands, stubs.attribution_model, key="sample_index", base_sleep=0.0)
    return out.select("sample_index", (F.col("raw_text").isNull() & F.col("error").isNull()).alias("parsed"), "error_type",
                      "missing_skill", "error")


def generation_job(spark: SparkSession, sf: str) -> DataFrame:
    """Two samples per attribution, up to 4 attempts each, F2 gate."""
    from evalloop.plans import stubs
    bad, cands = _bad_for_jobs(spark, sf)
    attr = en.attribution_job(bad, cands, stubs.attribution_model, key="sample_index", base_sleep=0.0)
    gen = en.generation_job(attr, stubs.generation_model, key="sample_index", num_per_case=2, base_sleep=0.0)
    return gen.select("sample_index", F.col("sample").cast("int").alias("sample"), "accepted", "attempt",
                      "instruction")


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid
    from evalloop.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _streamed(spark: SparkSession, sf: str, name: str, drops: int) -> str:
    """The store after ``drops`` drops of candidates, each judged by a restart of the stream (at least one micro-batch each)."""
    from evalloop.streaming import incremental as inc
    root = _scratch(spark, name)
    gold = fx.gold_problems(spark, sf)
    cands = fx.candidates(spark, sf).join(gold.select("sample_index", "judge_key"), "sample_index") \
        .select("judge_key", "cand_idx", "text")
    for drop in range(drops):
        cands.filter(F.col("cand_idx") % drops == drop).write.parquet(f"{root}/drops/d{drop}")
        inc.start_incremental_judge(spark, f"{root}/drops/*", gold, f"{root}/store", f"{root}/ckpt", k=DEFAULT_K,
                                    fan_in=2).awaitTermination()
    return f"{root}/store"


def incremental_judge(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates land in three drops; the stream is restarted for each, re-judges the questions that it touches
    and replaces their verdicts; the store merges its parts; readers take the latest."""
    from evalloop.streaming import incremental as inc
    v = inc.current_verdicts(spark, _streamed(spark, sf, "incremental", 3))
    return v.select("judge_key", "n_candidates", "pass_at_1", "pass_at_k")


def loop_two_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of the loop with stand-in models; inference answers more
    candidates correctly as the training snapshot grows."""
    from evalloop.plans import loop as lp
    from evalloop.plans import stubs
    root = _scratch(spark, "loop")
    gold = fx.gold_problems(spark, sf)
    base = fx.candidates(spark, sf).join(gold.select("sample_index", "judge_key", "answer"), "sample_index")

    def infer(it: int, snapshot: str) -> DataFrame:
        # Round it fixes the candidates of every (it+2)-th order: a stand-in for a better model.
        fixed = F.when(F.col("sample_index") % (it + 2) == 0, F.col("answer")).otherwise(F.col("text"))
        return base.select("judge_key", "cand_idx", fixed.alias("text"))

    seed = training_build(spark, sf).select("instruction", "input", "output")
    cfg = lp.LoopConfig(root=root, rounds=2, k=1, samples_per_case=1, max_attempts=2, base_sleep=0.0)
    return lp.run_loop(spark, cfg, gold, seed, infer, stubs.attribution_model, stubs.generation_model).drop("run_name")


# ---------------------------------------------------------------------------
# Further operators of the inventory
# ---------------------------------------------------------------------------
def flat_boxed(spark: SparkSession, sf: str) -> DataFrame:
    """T2 next to T1: the flat regex truncates nested boxes."""
    c = fx.candidates(spark, sf)
    return c.select("sample_index", "cand_idx", tx.last_flat_boxed("text").alias("flat"),
                    tx.last_boxed("text").alias("balanced"))


def response_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text of a raw API response (``output_text``, else message parts)."""
    e = fx.read_table(spark, sf, "events").select("event_id", "user_id", "event_type")
    part = lambda t, txt: F.struct(F.lit(t).alias("type"), txt.alias("text"), F.lit(None).cast("string").alias("output_text"))
    output = F.array(
        F.struct(F.lit("message").alias("type"), F.array(
            part("output_text", F.concat(F.lit("part "), F.col("user_id").cast("string"))),
            part("refusal", F.lit("ignored")),
            part("text", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.lit("  ")))
        ).alias("content")),
        F.struct(F.lit("reasoning").alias("type"), F.array(part("output_text", F.lit("hidden"))).alias("content")),
    )
    ot = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.lit(" "))
    return e.select("event_id", tx.response_text(ot, output).alias("text"))


def recover_user_text(spark: SparkSession, sf: str) -> DataFrame:
    """Q5: user text from chat markup, minus the step-by-step suffix."""
    conv = fx.read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    markup = F.when(F.col("turn") % 2 == 0, F.concat(
        F.lit("<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\n"), F.col("text"),
        F.lit("\nPlease reason step by step, and put your final answer within \\boxed{}.<|im_end|>\n"
              "<|im_start|>assistant\n"))).otherwise(F.col("text"))
    return conv.select("conv_id", "turn", tx.recover_user_text(markup).alias("user_text"))


def cot_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Q8 + Q9 + Q2 over the problems table."""
    b = benchmark_build(spark, sf)
    return b.select("dataset", "sample_index",
                    pr.cot_prompt("question", "answer").alias("cot_prompt"),
                    pr.milestone_prompt("question", "answer").alias("milestone_prompt"),
                    pr.append_instruction("question", pr.SECTIONS_INSTRUCTION).alias("sections_prompt"))


def dataset_short_names(spark: SparkSession, sf: str) -> DataFrame:
    """P10 over the dataset ids of the documents."""
    d = fx.read_table(spark, sf, "documents").select(F.concat(F.lit("Org/"), F.upper("source")).alias("dataset_id"))
    return d.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).select(
        "dataset_id", sh.dataset_short_name("dataset_id").alias("name"), "n")


def flat_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Correct / total over every judged candidate."""
    return mt.flat_accuracy(verdicts(spark, sf), "final_correct")


def latest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Highest ``checkpoint-<n>`` per run over a listing derived from pages."""
    p = fx.read_table(spark, sf, "pages").select(
        (F.col("page_id") % 5).alias("run"),
        F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("tmp-"), F.col("page_id").cast("string")))
        .otherwise(F.concat(F.lit("checkpoint-"), (F.col("page_id") * 10).cast("string"))).alias("name"))
    return sm.latest_by_step(p, ["run"], "name")


def cot_job(spark: SparkSession, sf: str) -> DataFrame:
    """Worked-solution rows from the problems table with a stand-in model."""
    from evalloop.plans import stubs
    rows = benchmark_build(spark, sf).withColumn("row_idx", F.concat_ws("::", "dataset_id", F.col("sample_index").cast("string")))
    out = en.cot_job(rows, stubs.cot_model, key="row_idx")
    return out.select("row_idx", "output", "system")


def running_stats(spark: SparkSession, sf: str) -> DataFrame:
    """pass@1 / pass@k over everything the incremental judge has stored, from totals of signed changes."""
    from evalloop.streaming import incremental as inc
    return inc.running_stats(spark, _streamed(spark, sf, "incremental-stats", 2))


def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two sources, tagged with where they come from and indexed within it."""
    docs = fx.read_table(spark, sf, "documents").select("doc_id", "source")
    parts = [sh.tag_provenance(docs.filter(F.col("source") == s), s, f"docs/{s}", level, ["doc_id"])
             for s, level in (("src0", "hard"), ("src1", "easy"))]
    return mg.union_datasets(parts).select(
        "doc_id", *[F.col("_" + c).alias(c) for c in ("dataset", "dataset_id", "difficulty", "sample_index")])


def difficulty_preset(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset whose id has a preset difficulty, among others."""
    raw = fx.doc_problems(spark, sf)
    ident = F.when(F.col("source") == "src0", F.lit(sh.MATH500_ID)).otherwise(F.concat(F.lit("docs/"), F.col("source")))
    rows = sh.benchmark_rows(raw, F.col("source"), ident, order_cols=["doc_id"])
    return rows.select("dataset", "sample_index", "difficulty")


def pick_one(spark: SparkSession, sf: str) -> DataFrame:
    """L4: one document by seeded hash."""
    docs = fx.read_table(spark, sf, "documents").select("doc_id", "source")
    return sm.pick_one(docs, "doc_id", order=seeded_order("doc_id"))


def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """L5/L6 + L2: the orders' places in a seeded shuffle."""
    o = fx.read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    shuffled = sm.seeded_shuffle(o, ["o_orderkey"], order=seeded_order("o_orderkey", 7))
    return sm.index_within_group(shuffled, ["o_orderpriority"], ["shuffle_key", "o_orderkey"], "place").select(
        "o_orderkey", "place")


def missing_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shards that an index of the line items' parts names and a listing of the stored ones lacks."""
    index = fx.read_table(spark, sf, "lineitem").select(F.create_map(
        F.concat(F.lit("layer."), F.col("l_linenumber").cast("string")),
        F.concat(F.lit("shard-"), (F.col("l_partkey") % 97).cast("string"))).alias("weight_map"))
    listing = fx.read_table(spark, sf, "part").filter(F.col("p_partkey") % 97 < 60).select(
        F.concat(F.lit("shard-"), (F.col("p_partkey") % 97).cast("string")).alias("file")).distinct()
    return sm.missing_shards(index, listing)


def union_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of different columns as one table, the missing ones null."""
    docs = fx.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    items = fx.read_table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.length("text").alias("size"))
    return mg.union_datasets([docs, items]).select("id", "lang", "size")


def judged_rows(spark: SparkSession, sf: str) -> DataFrame:
    """F6 + D7: rows that have a verdict and whose question is in the current set."""
    pq = per_question(spark, sf, ks=(DEFAULT_K,))
    partly = pq.withColumn("pass_at_k", F.when(F.col("n_candidates") > 2, F.col("pass_at_k")))
    current = fx.gold_problems(spark, sf).filter(F.col("sample_index") % 4 != 0).select("judge_key")
    return jd.judged_only(jd.restrict_to_current(partly, current)).select("judge_key", "n_candidates", "pass_at_k")


def mixed_k_summary(spark: SparkSession, sf: str) -> DataFrame:
    """J8 + J4: one summary over rows judged with different k, with the mismatches counted."""
    own = F.when(F.col("sample_index") % 3 == 0, 1).when(F.col("sample_index") % 3 == 1, 3).otherwise(8)
    return mt.overall_summary(per_question(spark, sf).filter(F.col("k") == own)).select(
        "count", "pass_at_1", "pass_at_k", "k", "n_distinct_k", "k_mismatch")


def stripped_validation(spark: SparkSession, sf: str) -> DataFrame:
    """V1 in stripped mode."""
    return va.validate_rows(_validation_input(spark, sf), mode="stripped")


def tolerant_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of JSON lines with defects, written and read back; every object with a key stays."""
    from evalloop.sources import io
    e = fx.read_table(spark, sf, "events").select("event_id", "user_id")
    m, key, v = F.col("event_id") % 14, F.col("event_id").cast("string"), F.col("user_id").cast("string")
    own = F.concat(F.lit('"key": "k'), key, F.lit('", "v": '))
    whole = F.concat(F.lit("{"), own, v, F.lit("}"))
    line = (F.when(m == 0, whole)
            .when(m == 1, F.concat(F.lit('  {"v": "text", "key": "k'), key, F.lit('"}')))
            .when(m == 2, F.concat(F.lit("{"), own))
            .when(m == 3, F.concat(F.lit('{"key": "", "v": '), v, F.lit("}")))
            .when(m == 4, F.concat(F.lit("["), whole, F.lit("]")))
            .when(m == 5, F.concat(F.lit("\t "), whole, F.lit("\t")))
            .when(m == 6, F.concat(F.lit('{"key": "old", "v": 0, '), own, v, F.lit("}")))
            .when(m == 7, F.concat(F.lit("{"), own, F.lit("NaN}")))
            .when(m == 8, F.concat(F.lit("{"), own, F.lit("-Infinity}")))
            .when(m == 9, F.concat(whole, F.lit(" trailing")))
            .when(m == 10, F.concat(whole, F.lit(",")))
            .when(m == 11, F.concat(whole, whole))
            .when(m == 12, F.concat(F.lit("{'key': 'k"), key, F.lit("'}"))).otherwise(F.lit("")))
    path = _scratch(spark, "log")
    e.select(line.alias("value")).write.text(path)
    return io.read_keyed_jsonl(spark, path, T.StructType([T.StructField("key", T.StringType()), T.StructField("v", T.LongType())]),
                               "key").select("key", "v")


def auto_reader(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one array each and files of lines, some malformed, below one folder; each file tells what it is."""
    from evalloop.sources import io
    e = fx.read_table(spark, sf, "events").select("event_id", "user_id").withColumn("block", F.floor(F.col("event_id") / 1000))
    item = F.concat(F.lit('{"key": '), F.col("event_id").cast("string"), F.lit(', "v": '), F.col("user_id").cast("string"), F.lit("}"))
    cut = (F.col("block") % 2 == 1) & (F.col("event_id") % 5 == 0)
    items = e.groupBy("block").agg(F.collect_list(F.when(cut, F.concat(item, F.lit(" x"))).otherwise(item)).alias("items"))
    whole = F.when(F.col("block") % 2 == 0, F.concat(F.lit("\t\n [\n"), F.array_join("items", ",\n"), F.lit("\n]"))).otherwise(
        F.array_join("items", "\n"))
    path = _scratch(spark, "mixed-files")
    items.select(whole.alias("value"), "block").write.partitionBy("block").text(path)
    return io.read_json_or_jsonl(spark, path, T.StructType([T.StructField("key", T.LongType()), T.StructField("v", T.LongType())])).select("key", "v")


def appended_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of JSON lines, written once and appended to; read back, the last line of each key wins."""
    from evalloop.sources import io
    e = fx.read_table(spark, sf, "events").select(
        F.concat(F.lit("k"), (F.col("event_id") % 997).cast("string")).alias("key"), F.col("event_id").alias("seq"), F.col("user_id").alias("v"))
    path = _scratch(spark, "appended")
    io.write_table(e.filter("seq % 3 = 0"), path, fmt="json")
    io.append_rows(e.filter("seq % 3 <> 0"), path, fmt="json")
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("v", T.LongType())])
    return jd.last_wins(io.read_keyed_jsonl(spark, path, schema, "key"), "key", "seq").select("key", "seq", "v")


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A registry of files per dataset; the highest version wins."""
    from evalloop.sources import io
    o = fx.read_table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("dataset_name"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file_name"),
        F.col("o_orderkey").alias("version"))
    odd = F.col("version") % 2 == 1
    return io.upsert_manifest(o.filter(~odd), o.filter(odd)).select("dataset_name", "file_name", "version")


def split_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stored by split; without the asked one, the first of the preference order is read."""
    from evalloop.sources import io
    docs = fx.read_table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("train").alias("split"))
    path = _scratch(spark, "splits")
    io.write_table(docs, path, partition_by=["split"])
    return io.resolve_split(spark, path, "test").select("doc_id", "split")


def answer_values(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of every shape (a variant by row, a struct, an array, a map) as text."""
    k = F.col("o_orderkey").cast("string")
    m = F.col("o_orderkey") % 8
    raw = (F.when(m == 0, F.concat(F.lit('{"value": " '), k, F.lit(' "}'))).when(m == 1, F.lit('{"value": null}'))
           .when(m == 2, F.concat(F.lit('{"x":'), k, F.lit("}"))).when(m == 3, F.concat(F.lit("["), k, F.lit("]")))
           .when(m == 4, F.concat(F.lit("["), k, F.lit(",2]"))).when(m == 5, F.lit("null"))
           .when(m == 6, F.concat(F.lit('" '), k, F.lit('  "'))).otherwise(k))
    o = fx.read_table(spark, sf, "orders").select("o_orderkey").select(
        "o_orderkey", F.parse_json(raw).alias("any"), F.struct(F.when(m != 1, F.concat(F.lit(" "), k)).alias("value")).alias("boxed"),
        F.when(m == 0, F.array(k)).when(m == 1, F.array(k, F.lit("2"))).alias("listed"),
        F.when(m % 2 == 0, F.create_map(F.lit("value"), k)).when(m == 1, F.create_map(F.lit("x"), k)).alias("mapped"))
    return o.select("o_orderkey", *[sh.answer_value(o, c).alias(c) for c in ("any", "boxed", "listed", "mapped")])


def prompt_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The question field that a row's dataset uses, else the row's JSON."""
    raw = fx.doc_problems(spark, sf)
    ident = F.when(F.col("source") == "src0", "openai/gsm8k").when(F.col("source") == "src1", sh.MATH500_ID).otherwise("docs")
    rows = raw.select("doc_id", "problem", "question", ident.alias("_dataset_id"))
    return rows.select("doc_id", sh.prompt_question(rows).alias("asked"))


def completions_to_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """T9 + T5 + P14: completions, normalised to three sections first, as one row of predictions per question."""
    gold = fx.gold_problems(spark, sf)
    comp = fx.candidates(spark, sf).withColumn("text", tx.three_sections("text"))
    rows = sh.prediction_rows(gold, comp, key="sample_index")
    return rows.select("sample_index", F.array_join(F.transform("predictions", lambda p: p["final_answer"]), "|").alias("finals"))


def dataset_full(spark: SparkSession, sf: str) -> DataFrame:
    """L3 in full mode: every document with its place in the seeded order of its source."""
    docs = fx.read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset"))
    return sm.sample_per_group(docs, "dataset", "doc_id", n=None, order=seeded_order("doc_id")).select(
        "dataset", "doc_id", "sample_rank")


def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    """V2: the first 20 error lines."""
    return va.first_errors(validate_rows(spark, sf), 20)


def redelivered_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """J2 + I1 in batch: every third output is delivered twice and counts once."""
    cands = fx.candidates(spark, sf)
    twice = cands.unionByName(cands.filter(F.col("sample_index") % 3 == 0))
    return jd.pass_at_k_from_candidates(fx.gold_problems(spark, sf), twice, [DEFAULT_K], key="sample_index", carry=["judge_key"],
                                        redelivered=True).select("judge_key", "n_candidates", "pass_at_1", "pass_at_k")
