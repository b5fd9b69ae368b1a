"""DuckDB SQL for each registered query: the same fixture rows and rules, written independently.

The fixtures use integer arithmetic only and texts whose blanks are plain
spaces and line feeds, so DuckDB's RE2 regexes and ``trim`` agree with the
Python rules the Spark side implements in full.
"""

from __future__ import annotations

NL = "chr(10)"
WS_CHARS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


# ---------------------------------------------------------------------------
# Fixture CTEs (mirror evalloop.sources.fixtures)
# ---------------------------------------------------------------------------
GOLD = r"""
gold AS (
  SELECT 'Order ' || CAST(o_orderkey AS VARCHAR) || ': what is its check digit?' AS question,
         CASE WHEN o_orderkey % 5 = 0 THEN 'Work it out.' || chr(10) || '#### ' || CAST((o_orderkey * 7) % 10 AS VARCHAR)
              ELSE 'The check digit is \boxed{' || CAST((o_orderkey * 7) % 10 AS VARCHAR) || '}.' END AS answer,
         o_orderpriority AS dataset,
         'orders/' || o_orderpriority AS dataset_id,
         o_orderkey AS sample_index,
         'orders/' || o_orderpriority || '::' || CAST(o_orderkey AS VARCHAR) AS judge_key
  FROM orders)"""

CANDS = r"""
cands AS (
  SELECT l_orderkey AS sample_index,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                 l_quantity, l_extendedprice) - 1 AS INTEGER) AS cand_idx,
         CASE l_linenumber % 4
           WHEN 0 THEN 'We add the parts.' || chr(10) || 'So the result is $\boxed{' || CAST((l_orderkey * 7 + l_partkey % 3) % 10 AS VARCHAR) || '}$.'
           WHEN 1 THEN 'First guess \boxed{' || CAST(((l_orderkey * 7 + l_partkey % 3) % 10 + 3) % 10 AS VARCHAR)
                       || '}, but checking again gives \boxed{\boxed{' || CAST((l_orderkey * 7 + l_partkey % 3) % 10 AS VARCHAR) || '}} ok'
           WHEN 2 THEN 'Compute the digit.' || chr(10) || '#### ' || CAST((l_orderkey * 7 + l_partkey % 3) % 10 AS VARCHAR) || ' ;' || chr(10) || 'end of work'
           ELSE 'Line one' || chr(10) || '  ' || CAST((l_orderkey * 7 + l_partkey % 3) % 10 AS VARCHAR) || '.  ' || chr(10)
         END AS text
  FROM lineitem)"""


def boxed(t: str) -> str:
    """Last boxed content for texts nesting at most one level below the box."""
    suffix = f"string_split({t}, '\\boxed{{')[-1]"
    body = f"regexp_extract({suffix}, '^((?:[^{{}}]|\\{{[^{{}}]*\\}})*)\\}}', 1)"
    return f"CASE WHEN strpos({t}, '\\boxed{{') = 0 THEN '' ELSE {strip(body)} END"


HASH = r"(?m)####\s*(.+)$"


def final_answer_cte(name: str, src: str, text: str, cols: str) -> str:
    """CTE adding ``fa`` (final answer) to ``src`` via boxed -> #### -> last line."""
    lines = (f"list_filter(list_transform(string_split_regex(_t, '\\r\\n|[\\n\\r]'), "
             f"lambda x: {strip('x')}), lambda x: x <> '')")
    return f"""
{name}_b AS (SELECT {cols}, {text} AS _t, {boxed(text)} AS _bx FROM {src}),
{name} AS (
  SELECT {cols},
         CASE WHEN _bx <> '' THEN _bx
              WHEN regexp_matches(_t, '{HASH}') THEN {strip(f"regexp_extract(_t, '{HASH}', 1)")}
              ELSE coalesce({lines}[-1], '') END AS fa
  FROM {name}_b)"""


def norm(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\s+', '', 'g'), '[.,;:，。；：]+$', '')"


PRED_FA = final_answer_cte("pf", "cands", "text", "sample_index, cand_idx")
GOLD_FA = final_answer_cte("gf", "gold", "answer", "sample_index, judge_key, dataset, question, answer")

VERDICTS = f"""
{PRED_FA.strip()},
{GOLD_FA.strip()},
verdicts AS (
  SELECT g.sample_index, g.judge_key, g.dataset, g.question, g.answer,
         CAST(coalesce(p.cand_idx, 0) AS INTEGER) AS cand_idx,
         coalesce(p.fa, '') AS pred_final, g.fa AS gt_final,
         (coalesce({norm('p.fa')}, '') <> '' AND {norm('p.fa')} = {norm('g.fa')}) AS final_correct
  FROM gf g LEFT JOIN pf p ON g.sample_index = p.sample_index)"""


def per_question(ks=(1, 3, 8), src: str = "verdicts") -> str:
    arms = "\n  UNION ALL\n  ".join(
        f"SELECT sample_index, judge_key, dataset, question, answer, {k} AS k, n_candidates, pass_at_1, "
        f"pk{k} AS pass_at_k FROM pq0" for k in ks)
    pk = ", ".join(f"coalesce(bool_or(final_correct AND cand_idx < {max(k, 1)}), false) AS pk{k}" for k in ks)
    return f"""
pq0 AS (
  SELECT sample_index, any_value(judge_key) AS judge_key, any_value(dataset) AS dataset,
         any_value(question) AS question, any_value(answer) AS answer,
         count(*) AS n_candidates,
         coalesce(bool_or(final_correct AND cand_idx = 0), false) AS pass_at_1, {pk}
  FROM {src} GROUP BY sample_index),
pq AS (
  {arms})"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


def q_final_answer_extract() -> str:
    return _with(CANDS, PRED_FA) + "\nSELECT sample_index, cand_idx, fa AS pred_final FROM pf"


def q_answer_normalise() -> str:
    return _with(CANDS, PRED_FA) + f"\nSELECT sample_index, cand_idx, {norm('fa')} AS pred_norm FROM pf"


def q_judge_candidates() -> str:
    return _with(GOLD, CANDS, VERDICTS) + "\nSELECT judge_key, cand_idx, pred_final, gt_final, final_correct FROM verdicts"


def q_pass_at_k() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question()) + (
        "\nSELECT judge_key, dataset, k, n_candidates, pass_at_1, pass_at_k FROM pq")


def q_stats_rollup() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question()) + """
SELECT CASE WHEN GROUPING(dataset) = 0 THEN 'dataset' ELSE 'overall' END AS scope,
       CASE WHEN GROUPING(dataset) = 0 THEN coalesce(dataset, '') END AS dataset,
       k, count(*) AS n,
       CAST(sum(CAST(pass_at_1 AS INTEGER)) AS DOUBLE) / count(*) AS pass_at_1,
       CAST(sum(CAST(pass_at_k AS INTEGER)) AS DOUBLE) / count(*) AS pass_at_k
FROM pq GROUP BY GROUPING SETS ((k, dataset), (k))"""


def q_bad_cases() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question((8,))) + """
SELECT judge_key, dataset, sample_index, question, answer, n_candidates FROM pq WHERE NOT pass_at_k"""


def q_resume_anti_join() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question((8,))) + """
SELECT judge_key, n_candidates, pass_at_1, pass_at_k, (sample_index % 2 = 1) AS resumed FROM pq"""


def q_last_wins() -> str:
    return """
SELECT user_id, event_id, event_type, value FROM (
  SELECT user_id, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1"""


def _summary_metrics(k: int) -> str:
    third = "" if k == 1 else f"""
  UNION ALL SELECT 'pass@{k}', CAST(sum(CAST(pass_at_k AS INTEGER)) AS DOUBLE) / count(*) FROM pq WHERE k = {k}"""
    return f"""
m{k} AS (
  SELECT 'count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM pq WHERE k = {k}
  UNION ALL SELECT 'pass@1', CAST(sum(CAST(pass_at_1 AS INTEGER)) AS DOUBLE) / count(*) FROM pq WHERE k = {k}{third})"""


def q_compare_rounds() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question(), _summary_metrics(1), _summary_metrics(8)) + """
SELECT coalesce(a.metric, b.metric) AS metric, a.value AS iter_a, b.value AS iter_b, b.value - a.value AS delta
FROM m1 a FULL OUTER JOIN m8 b ON a.metric = b.metric"""


def q_round_history() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question((1, 2, 4, 8))) + """,
rounds AS (
  SELECT k, CAST(count(*) AS DOUBLE) AS c,
         CAST(sum(CAST(pass_at_1 AS INTEGER)) AS DOUBLE) / count(*) AS p1,
         CAST(sum(CAST(pass_at_k AS INTEGER)) AS DOUBLE) / count(*) AS pk
  FROM pq GROUP BY k),
long AS (
  SELECT 'fixture' AS run_name, k AS iter, 'count' AS metric, c AS value FROM rounds
  UNION ALL SELECT 'fixture', k, 'pass@1', p1 FROM rounds
  UNION ALL SELECT 'fixture', k, 'pass@k', pk FROM rounds)
SELECT run_name, iter, metric, value,
       lag(value) OVER (PARTITION BY run_name, metric ORDER BY iter) AS prev_value,
       value - lag(value) OVER (PARTITION BY run_name, metric ORDER BY iter) AS delta
FROM long"""


def q_dataset_counts() -> str:
    return "SELECT coalesce(source, 'unknown') AS dataset, count(*) AS n FROM documents GROUP BY 1"


# ---------------------------------------------------------------------------
# Batch 2: shaping, sampling, cleaning, parsing, JSON, near-duplicates, prompts, validation, jobs
# ---------------------------------------------------------------------------
def lit(s: str) -> str:
    """A Python string as a DuckDB literal (line feeds via chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) if len(parts) > 1 \
        else "'" + s.replace("'", "''") + "'"


def nonblank(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def lines(x: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({x}, '\\r\\n|[\\n\\r]'), lambda y: {strip('y')}), "
            f"lambda y: y <> '')")


SEEDED = "(({c}) * 48271 + 42) % 2147483647"

DOC_PROBLEMS = r"""
rawp AS (
  SELECT doc_id, source,
         CASE WHEN doc_id % 6 IN (0, 1, 2) THEN text WHEN doc_id % 6 = 3 THEN '   ' END AS problem,
         CASE WHEN doc_id % 6 IN (3, 4) THEN 'Q' || CAST(doc_id AS VARCHAR) || ': ' || text END AS question,
         CASE doc_id % 6
           WHEN 0 THEN 'Reasoning.' || chr(10) || 'So $\boxed{\frac{' || CAST(n_chars AS VARCHAR) || '}{' || CAST(doc_id % 7 + 1 AS VARCHAR) || '}}$.'
           WHEN 1 THEN 'Reasoning.' || chr(10) || '#### ' || CAST(n_chars AS VARCHAR)
           WHEN 2 THEN 'Reasoning without a final line'
           WHEN 3 THEN '' WHEN 5 THEN text END AS solution,
         CASE WHEN doc_id % 6 IN (2, 3) THEN CAST(n_chars % 97 AS VARCHAR) WHEN doc_id % 6 = 4 THEN ' ' END AS final_answer
  FROM documents)"""


def q_benchmark_build() -> str:
    rowjson = ("to_json(struct_pack(doc_id := doc_id, source := source, problem := problem, question := question, "
               "solution := solution, final_answer := final_answer))::VARCHAR")
    return _with(DOC_PROBLEMS) + f""",
s1 AS (
  SELECT *, coalesce({nonblank('problem')}, {nonblank('question')}, {rowjson}) AS q,
         coalesce({nonblank('solution')}, coalesce({strip('final_answer')}, '')) AS sol
  FROM rawp),
s2 AS (SELECT *, {boxed('sol')} AS sol_box FROM s1),
s3 AS (
  SELECT *, coalesce({nonblank('final_answer')}, nullif(sol_box, ''),
                     CASE WHEN regexp_matches(sol, '{HASH}') THEN {strip(f"regexp_extract(sol, '{HASH}', 1)")} END,
                     '') AS fin
  FROM s2)
SELECT q AS question,
       CASE WHEN fin = '' THEN sol WHEN sol = '' THEN fin
            WHEN sol_box = '' AND NOT regexp_matches(sol, '{HASH}')
              THEN sol || chr(10) || chr(10) || CASE WHEN strpos(fin, '\\boxed{{') > 0 THEN fin ELSE '\\boxed{{' || fin || '}}' END
            ELSE sol END AS answer,
       source AS dataset, 'docs/' || source AS dataset_id, 'unknown' AS difficulty,
       CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS sample_index
FROM s3"""


TRAINING = f"""
training AS (
  SELECT u.conv_id, u.turn, {strip('u.text')} AS instruction, '' AS input, {strip('a.text')} AS output
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user' AND {strip('a.text')} <> '')"""


def q_training_build() -> str:
    return _with(TRAINING) + "\nSELECT conv_id, turn, instruction, input, output FROM training"


def q_sample_per_dataset() -> str:
    return f"""
SELECT dataset, doc_id, CAST(rn - 1 AS INTEGER) AS sample_rank FROM (
  SELECT source AS dataset, doc_id,
         row_number() OVER (PARTITION BY source ORDER BY {SEEDED.format(c='doc_id')}, doc_id) AS rn
  FROM documents) WHERE rn <= 4"""


def q_dataset_select() -> str:
    return f"""
WITH reg AS (
  SELECT * FROM (VALUES ('src0', 0, 'fixed', 'hard'), ('src1', 1, 'fixed', 'hard'), ('src2', 2, 'dynamic', 'dynamic'),
                        ('src3', 3, 'dynamic', 'dynamic'), ('src4', 4, 'dynamic', 'dynamic'))
         AS t(source, spec_idx, kind, difficulty)),
pick AS (SELECT arg_min(source, {SEEDED.format(c='spec_idx')}) AS source FROM reg WHERE kind = 'dynamic'),
chosen AS (SELECT source FROM reg WHERE kind = 'fixed' UNION ALL SELECT source FROM pick),
r AS (SELECT d.doc_id, d.source, g.difficulty FROM documents d JOIN reg g ON d.source = g.source
      WHERE d.source IN (SELECT source FROM chosen))
SELECT source AS dataset, 'docs/' || source AS dataset_id, difficulty, doc_id, CAST(rn - 1 AS BIGINT) AS sample_index
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {SEEDED.format(c='doc_id')}, doc_id) AS rn FROM r)
WHERE rn <= 4"""


def q_head_limit() -> str:
    return "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 25"


RAW = r"""
raw AS (
  SELECT doc_id, source, text AS source_question,
         CASE doc_id % 8
           WHEN 0 THEN 'Question:' || chr(10) || text || chr(10) || 'Answer:' || chr(10) || 'We compute it step by step.' || chr(10) || text || chr(10) || 'The value is ' || CAST(n_chars % 100 AS VARCHAR) || '.' || chr(10) || '$\boxed{' || CAST(n_chars % 100 AS VARCHAR) || '}$.'
           WHEN 1 THEN '<think>draft</think>' || chr(10) || 'Question: New problem about item ' || CAST(doc_id AS VARCHAR) || ' and its parts?' || chr(10) || 'Answer: ' || 'We compute it step by step.' || chr(10) || text || chr(10) || 'The value is ' || CAST(n_chars % 100 AS VARCHAR) || '.' || chr(10) || '$\boxed{' || repeat('{', 20) || CAST(n_chars % 100 AS VARCHAR) || repeat('}', 20) || '}$.'
           WHEN 2 THEN 'Question: Short?' || chr(10) || 'Answer: ' || 'We compute it step by step.' || chr(10) || text || chr(10) || 'The value is ' || CAST(n_chars % 100 AS VARCHAR) || '.' || chr(10) || '$\boxed{' || CAST(n_chars % 100 AS VARCHAR) || '}$.'
           WHEN 3 THEN 'Question: A different question about ' || CAST(n_chars AS VARCHAR) || ' things.' || chr(10) || 'Answer: ' || 'We compute it step by step.' || chr(10) || text || chr(10) || 'The value is ' || CAST(n_chars % 100 AS VARCHAR) || '.' || chr(10) || 'no box here'
           WHEN 4 THEN 'question: first draft about ' || CAST(doc_id AS VARCHAR) || ' items and more' || chr(10) || 'ANSWER: answer: ' || 'We compute it step by step.' || chr(10) || text || chr(10) || 'The value is ' || CAST(n_chars % 100 AS VARCHAR) || '.' || chr(10) || '$\boxed{' || CAST(n_chars % 100 AS VARCHAR) || '}$.' || chr(10) || 'Question:'
           WHEN 5 THEN '<Plan>plan ' || CAST(doc_id AS VARCHAR) || ' ' || text || '<Solve>solve</Solve><Answer>' || '$\boxed{' || CAST(n_chars % 100 AS VARCHAR) || '}$.' || '</Answer>'
           WHEN 6 THEN 'Question: Find the value for record ' || CAST(doc_id AS VARCHAR) || ' please.' || chr(10) || 'Answer: Question: leaked header' || chr(10) || text || chr(10) || '$\boxed{' || CAST(n_chars % 100 AS VARCHAR) || '}$.'
           ELSE '<think>' || chr(10) || 'steps for ' || CAST(doc_id AS VARCHAR) || chr(10) || '</think>' || chr(10) || 'We compute it step by step.' || chr(10) || text || chr(10) || 'The value is ' || CAST(n_chars % 100 AS VARCHAR) || '.' || chr(10) || '**Final Answer:** \boxed{' || CAST(n_chars % 100 AS VARCHAR) || '}'
         END AS response
  FROM documents)"""


def strip_think_sql(x: str) -> str:
    return (f"replace(replace(regexp_replace({x}, '(?is)<think>.*?</think>\\s*', '', 'g'), '<think>', ''), "
            f"'</think>', '')")


def q_strip_think() -> str:
    return _with(RAW) + f"\nSELECT doc_id, {strip_think_sql('response')} AS cleaned FROM raw"


def unwrap_sql(x: str) -> str:
    t = f"regexp_replace({x}, '(?is)<\\|begin_of_thought\\|>(.*?)<\\|end_of_thought\\|>', '\\1', 'g')"
    t = f"regexp_replace({t}, '(?is)<\\|begin_of_solution\\|>(.*?)<\\|end_of_solution\\|>', '\\1', 'g')"
    t = f"regexp_replace({t}, '(?is)<think>(.*?)</think>', '\\1', 'g')"
    return strip(f"replace(replace({t}, '<think>', ''), '</think>', '')")


def q_unwrap_tags() -> str:
    return _with(RAW) + f"\nSELECT doc_id, {unwrap_sql('response')} AS unwrapped FROM raw"


def _find_from(tag: str, start: str) -> str:
    """1-based position of tag in t at or after start, or NULL."""
    return f"CASE WHEN strpos(substr(t, {start}), '{tag}') > 0 THEN {start} - 1 + strpos(substr(t, {start}), '{tag}') END"


def _section_sql(open_tag: str, close_tag: str, nexts: list[str]) -> str:
    st = f"(strpos(t, '{open_tag}') + {len(open_tag)})"
    ends = [_find_from(close_tag, st)] + [_find_from(n, st) for n in nexts]
    nxt = ends[1:]
    if len(nxt) == 2:
        nmin = f"CASE WHEN ({nxt[0]}) IS NULL THEN ({nxt[1]}) WHEN ({nxt[1]}) IS NULL THEN ({nxt[0]}) ELSE least({nxt[0]}, {nxt[1]}) END"
    elif len(nxt) == 1:
        nmin = nxt[0]
    else:
        nmin = "NULL"
    end = f"coalesce({ends[0]}, {nmin}, length(t) + 1)"
    return f"CASE WHEN strpos(t, '{open_tag}') = 0 THEN '' ELSE {strip(f'substr(t, {st}, {end} - {st})')} END"


def q_three_sections() -> str:
    plan = _section_sql("<Plan>", "</Plan>", ["<Solve>", "<Answer>"])
    solve = _section_sql("<Solve>", "</Solve>", ["<Answer>"])
    ans = _section_sql("<Answer>", "</Answer>", [])
    return _with(RAW) + f""",
t0 AS (SELECT doc_id, {strip(strip_think_sql('response'))} AS t FROM raw),
t1 AS (SELECT doc_id, t, {plan} AS plan, {solve} AS solve, {ans} AS ans0 FROM t0),
t2 AS (SELECT *, CASE WHEN strpos(t, '<Answer>') > 0 AND ans0 = '' THEN {strip("substr(t, strpos(t, '<Answer>') + 8)")} ELSE ans0 END AS ans FROM t1)
SELECT doc_id,
       CASE WHEN strpos(t, '<Plan>') = 0 AND strpos(t, '<Solve>') = 0 AND strpos(t, '<Answer>') = 0 THEN t
       ELSE '<Plan>' || chr(10) || {strip(strip_think_sql('plan'))} || chr(10) || '</Plan>' || chr(10) || chr(10)
         || '<Solve>' || chr(10) || {strip(strip_think_sql('solve'))} || chr(10) || '</Solve>' || chr(10) || chr(10)
         || '<Answer>' || chr(10) || {strip(strip_think_sql('ans'))} || chr(10) || '</Answer>' END AS normalised
FROM t2"""


QA_RE = r"(?is)^.*question:(.*?)answer:(.*)$"
def _nested(depth: int) -> str:
    """A character, or braces around text nested at most ``depth`` levels deeper (RE2 has no recursion)."""
    unit = "[^{}]"
    for _ in range(depth):
        unit = r"(?:[^{}]|\{" + unit + r"*\})"
    return unit


GATE_RE = r"\\boxed\{" + _nested(21) + r"+\}\s*\$?\s*[.。]?\s*$"

QA = f"""
qa0 AS (
  SELECT doc_id, source_question, response, {unwrap_sql('response')} AS u FROM raw),
qa1 AS (
  SELECT *, regexp_matches(u, '{QA_RE}') AS m,
         {strip(f"regexp_extract(u, '{QA_RE}', 1)")} AS q0, {strip(f"regexp_extract(u, '{QA_RE}', 2)")} AS a0
  FROM qa0),
qa AS (
  SELECT *, CASE WHEN m AND q0 <> '' AND a0 <> '' AND regexp_matches(coalesce({lines('a0')}[-1], ''), '{GATE_RE}')
                 THEN true ELSE false END AS ok
  FROM qa1)"""


def q_qa_parse() -> str:
    return _with(RAW, QA) + "\nSELECT doc_id, CASE WHEN ok THEN q0 END AS question, CASE WHEN ok THEN a0 END AS answer FROM qa"


def nf_sql(x: str) -> str:
    return f"lower(regexp_replace({strip(x)}, '\\s+', ' ', 'g'))"


def toks_sql(nf: str) -> str:
    return f"regexp_extract_all({nf}, '[a-z]+|\\d+|[^\\s]')"


def too_similar_sql(a: str, b: str) -> str:
    na, nb = nf_sql(a), nf_sql(b)
    ta, tb = toks_sql(na), toks_sql(nb)
    jac = (f"len(list_intersect(list_distinct({ta}), list_distinct({tb}))) / "
           f"greatest(1, len(list_distinct(list_concat({ta}, {tb}))))")
    return (f"(CASE WHEN {na} = '' OR {nb} = '' THEN false WHEN {na} = {nb} THEN true "
            f"WHEN len({ta}) < 12 OR len({tb}) < 12 THEN false "
            f"ELSE least(length({na}), length({nb})) >= 60 AND {jac} >= 0.92 END)")


def q_synthetic_accept() -> str:
    low = "lower(ltrim(a0, chr(32)||chr(9)||chr(10)||chr(13)))"
    out = f"CASE WHEN starts_with({low}, 'answer:') THEN {strip('substr(a0, strpos(a0, chr(58)) + 1)')} ELSE a0 END"
    return _with(RAW, QA) + f""",
g AS (
  SELECT doc_id, q0, {out} AS out,
         CASE WHEN NOT ok THEN 'parse_failed'
              WHEN {strip('source_question')} <> '' AND {too_similar_sql('q0', 'source_question')} THEN 'too_similar'
              WHEN starts_with({low}, 'question:') THEN 'answer_starts_with_question'
              WHEN length({strip('q0')}) < 20 THEN 'question_too_short'
              WHEN {strip(out)} = '' THEN 'empty_answer' END AS reason
  FROM qa)
SELECT doc_id, reason IS NULL AS accepted, reason AS reject_reason,
       CASE WHEN reason IS NULL THEN q0 END AS instruction, CASE WHEN reason IS NULL THEN out END AS output
FROM g"""


FJSON = """
fj AS (
  SELECT event_id, user_id, obj,
         CASE event_id % 5 WHEN 0 THEN obj
              WHEN 1 THEN 'Here is my analysis: ' || obj || ' Hope it helps.'
              WHEN 2 THEN '```json' || chr(10) || obj || chr(10) || '```'
              WHEN 3 THEN substr(obj, 1, length(obj) - 2)
              ELSE obj || ' and ' || props END AS text
  FROM (SELECT event_id, user_id, props,
               '{"error_type": "' || event_type || '", "missing_skill": "skill_' || CAST(user_id % 7 AS VARCHAR)
               || '", "detail": ' || props || '}' AS obj FROM events)),
fj1 AS (
  SELECT *, CASE WHEN strpos(text, '{') > 0 AND strpos(reverse(text), '}') > 0
                 THEN substr(text, strpos(text, '{'), length(text) - strpos(reverse(text), '}') + 2 - strpos(text, '{')) END AS span
  FROM fj),
attr AS (
  SELECT event_id, user_id, text,
         CASE WHEN json_valid(text) AND json_type(CASE WHEN json_valid(text) THEN text END) = 'OBJECT' THEN text
              WHEN json_valid(span) AND json_type(CASE WHEN json_valid(span) THEN span END) = 'OBJECT' THEN span END AS j
  FROM fj1),
attr2 AS (
  SELECT event_id, user_id, text, j IS NOT NULL AND j <> '{}' AS parsed,
         json_extract_string(j, '$.error_type') AS error_type, json_extract_string(j, '$.missing_skill') AS missing_skill,
         json_extract_string(j, '$.reason') AS reason, json_extract_string(j, '$.fix_suggestion') AS fix_suggestion
  FROM attr)"""


def q_tolerant_json() -> str:
    return _with(FJSON) + "\nSELECT event_id, parsed, error_type, missing_skill FROM attr2"


def q_error_profile() -> str:
    return _with(FJSON) + """
SELECT coalesce(error_type, '') AS error_type, coalesce(missing_skill, '') AS missing_skill, count(*) AS n
FROM attr2 GROUP BY 1, 2"""


def _nd_ctes(src: str, id_col: str, text_col: str, prefix: str) -> str:
    nf = nf_sql(text_col)
    return f"""
{prefix}nf AS (SELECT {id_col} AS id, {nf} AS nf FROM {src}),
{prefix}nf2 AS (SELECT * FROM {prefix}nf WHERE nf <> ''),
{prefix}grp AS (SELECT nf, min(id) AS rep FROM {prefix}nf2 GROUP BY nf),
{prefix}sets AS (
  SELECT rep, nf, list_distinct(t) AS s, len(list_distinct(t)) AS sz FROM (
    SELECT rep, nf, {toks_sql('nf')} AS t FROM {prefix}grp) WHERE len(t) >= 12 AND length(nf) >= 60)"""


def _jacc_ok(a: str, b: str) -> str:
    return (f"100 * least({a}.sz, {b}.sz) >= 92 * greatest({a}.sz, {b}.sz) AND "
            f"len(list_intersect({a}.s, {b}.s)) / greatest(1, len(list_distinct(list_concat({a}.s, {b}.s)))) >= 0.92")


def q_near_dup_pairs() -> str:
    return _with(_nd_ctes("documents", "doc_id", "text", "d")) + f"""
SELECT g.rep AS id_a, n.id AS id_b, 'equal' AS kind FROM dnf2 n JOIN dgrp g ON n.nf = g.nf WHERE n.id <> g.rep
UNION ALL
SELECT min(a.rep), b.rep, 'near' FROM dsets a JOIN dsets b ON a.rep < b.rep AND {_jacc_ok('a', 'b')} GROUP BY b.rep"""


ITEMS = """
items AS (
  SELECT item_id, text FROM benchmark
  UNION ALL SELECT 10000000 + doc_id, replace(text, ' ', '  ') || '  ' FROM documents WHERE doc_id % 37 = 0
  UNION ALL SELECT 20000000 + doc_id, text || ' zzextra' FROM documents WHERE doc_id % 41 = 0)"""


def q_decontaminate() -> str:
    return _with(ITEMS, _nd_ctes("documents", "doc_id", "text", "d"), _nd_ctes("items", "item_id", "text", "b")) + f""",
dmap AS (SELECT n.id, g.rep FROM dnf2 n JOIN dgrp g ON n.nf = g.nf)
SELECT n.id AS left_id, g.rep AS right_id, 'equal' AS kind FROM dnf2 n JOIN bgrp g ON n.nf = g.nf
UNION ALL
SELECT m.id, min(b.rep), 'near' FROM dsets a JOIN bsets b ON {_jacc_ok('a', 'b')} JOIN dmap m ON m.rep = a.rep
GROUP BY m.id"""


def q_near_dup_classes() -> str:
    return "WITH RECURSIVE " + _with(_nd_ctes("documents", "doc_id", "text", "d")).lstrip().removeprefix("WITH") + f""",
links AS (SELECT a.rep AS a, b.rep AS b FROM dsets a JOIN dsets b ON a.rep <> b.rep AND {_jacc_ok('a', 'b')}),
reach AS (SELECT rep AS r, rep AS o FROM dgrp UNION SELECT r.r, l.b FROM reach r JOIN links l ON l.a = r.o),
comp AS (SELECT r, min(o) AS component_id FROM reach GROUP BY r),
sizes AS (SELECT nf, count(*) AS n FROM dnf2 GROUP BY nf),
near AS (SELECT a AS rep, sum(s.n) AS near FROM links JOIN dgrp g ON g.rep = b JOIN sizes s ON s.nf = g.nf GROUP BY a)
SELECT n.id, c.component_id, (s.n - 1 + coalesce(near, 0))::BIGINT AS n_links
FROM dnf2 n JOIN dgrp g ON n.nf = g.nf JOIN sizes s ON s.nf = n.nf JOIN comp c ON c.r = g.rep LEFT JOIN near ON near.rep = g.rep
WHERE s.n - 1 + coalesce(near, 0) > 0"""


def q_decontaminate_links() -> str:
    return _with(ITEMS, _nd_ctes("documents", "doc_id", "text", "d"), _nd_ctes("items", "item_id", "text", "b")) + f""",
forms AS (
  SELECT a.nf AS x, b.nf AS y FROM dsets a JOIN bsets b ON {_jacc_ok('a', 'b')}
  UNION SELECT d.nf, b.nf FROM dgrp d JOIN bgrp b ON d.nf = b.nf),
met AS (SELECT d.id AS l, b.id AS r FROM forms JOIN dnf2 d ON d.nf = x JOIN bnf2 b ON b.nf = y)
SELECT 'left' AS side, l AS id, min(r) AS partner, count(*) AS n_links FROM met GROUP BY l
UNION ALL
SELECT 'right', r, min(l), count(*) FROM met GROUP BY r"""


def q_merge_dedup() -> str:
    return _with(_nd_ctes("documents", "doc_id", "text", "d")) + f""",
dups AS (
  SELECT n.id FROM dnf2 n JOIN dgrp g ON n.nf = g.nf WHERE n.id <> g.rep
  UNION SELECT b.rep FROM dsets a JOIN dsets b ON a.rep < b.rep AND {_jacc_ok('a', 'b')})
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT id FROM dups)"""


def q_merge_training() -> str:
    return _with(TRAINING, RAW, QA) + f""",
g AS (
  SELECT doc_id, q0,
         CASE WHEN starts_with(lower(ltrim(a0, chr(32)||chr(9)||chr(10)||chr(13))), 'answer:')
              THEN {strip('substr(a0, strpos(a0, chr(58)) + 1)')} ELSE a0 END AS out,
         CASE WHEN NOT ok THEN 'x'
              WHEN {strip('source_question')} <> '' AND {too_similar_sql('q0', 'source_question')} THEN 'x'
              WHEN starts_with(lower(ltrim(a0, chr(32)||chr(9)||chr(10)||chr(13))), 'question:') THEN 'x'
              WHEN length({strip('q0')}) < 20 THEN 'x' END AS reason
  FROM qa)
SELECT 0 AS part_idx, row_number() OVER (ORDER BY conv_id, turn) - 1 AS part_row, instruction, input, output FROM training
UNION ALL
SELECT 1, row_number() OVER (ORDER BY doc_id) - 1, q0, '', out FROM g WHERE reason IS NULL AND {strip('out')} <> ''"""


def _prompt_consts():
    from evalloop.operators import prompts as pr
    return pr


def q_prompt_table() -> str:
    pr = _prompt_consts()
    return _with(GOLD) + f"""
SELECT judge_key,
       CASE WHEN strpos(question, {lit(pr.FINAL_ANSWER_INSTRUCTION)}) > 0 THEN question
            WHEN rtrim(question, {WS_CHARS}) <> '' THEN rtrim(question, {WS_CHARS}) || chr(10) || chr(10) || {lit(pr.FINAL_ANSWER_INSTRUCTION)}
            ELSE {lit(pr.FINAL_ANSWER_INSTRUCTION)} END AS user_prompt,
       {lit(pr.DEFAULT_SYSTEM_PROMPT)} AS system_prompt, 'system: ' || {lit(pr.DEFAULT_SYSTEM_PROMPT)} || chr(10) || 'user: ' || user_prompt AS messages
FROM gold"""


def q_training_prompts() -> str:
    pr = _prompt_consts()
    p = lit(pr.TRAINING_USER_PREFIX)
    return _with(TRAINING) + f"""
SELECT conv_id, turn,
       {strip(f"CASE WHEN instruction <> '' AND NOT starts_with(ltrim(instruction, {WS_CHARS}), {p}) THEN {p} || ' ' || instruction ELSE instruction END")} AS user_prompt
FROM training"""


def q_attribution_prompts() -> str:
    head = ("A model answered this problem incorrectly. Reply with one JSON object with the keys "
            "\"error_type\" (short label), \"reason\", \"missing_skill\" and \"fix_suggestion\", "
            "and nothing else.\n\nProblem:\n")
    return _with(GOLD, CANDS, VERDICTS, per_question((8,))) + f""",
bullets AS (SELECT sample_index, string_agg(chr(10) || '- ' || text || chr(10), '' ORDER BY cand_idx) AS b
            FROM cands GROUP BY sample_index)
SELECT p.judge_key,
       {lit(head)} || p.question || {lit(chr(10) + chr(10) + 'Reference answer:' + chr(10))} || p.answer
       || {lit(chr(10) + chr(10) + 'Failed predictions:' + chr(10))} || coalesce(b.b, '') AS user_prompt
FROM pq p LEFT JOIN bullets b ON p.sample_index = b.sample_index WHERE NOT p.pass_at_k"""


def q_generation_prompts() -> str:
    head = ("Write a NEW problem on the same theme and level as the one below, aimed at the weakness in the "
            "analysis, clearly different from it, and solve it.\n\nOriginal problem (context only):\n")
    nl = "chr(10)"
    analysis = (f"CASE WHEN NOT parsed THEN 'Notes: ' || text ELSE 'Error type: ' || coalesce(error_type, '') || {nl} || "
                f"'Reason: ' || coalesce(reason, '') || {nl} || 'Missing skill: ' || coalesce(missing_skill, '') || {nl} || "
                f"'Suggested fix: ' || coalesce(fix_suggestion, '') END")
    return _with(FJSON) + f"""
SELECT event_id, {lit(head)} || 'Problem of user ' || CAST(user_id AS VARCHAR)
       || {lit(chr(10) + chr(10) + 'Analysis of the failure:' + chr(10))} || {analysis} AS user_prompt
FROM attr2"""


VALID_IN = f"""
vin AS (
  SELECT doc_id AS row_idx,
         CASE doc_id % 3 WHEN 0 THEN source_question
              WHEN 1 THEN 'Return your final response within \\boxed{{}}. ' || source_question
              ELSE 'short q' END AS instruction,
         response AS output
  FROM raw),
v1 AS (
  SELECT row_idx, instruction, output, {strip('instruction')} AS ins, {strip('output')} AS outs, lower(output) AS low,
         coalesce({lines('output')}[1], '') AS first_line,
         (length(lower(output)) - length(replace(lower(output), '<think>', ''))) // 7 AS n_open,
         (length(lower(output)) - length(replace(lower(output), '</think>', ''))) // 8 AS n_close,
         strpos(lower(output), '<think>') AS p_open, strpos(lower(output), '</think>') AS p_close
  FROM vin),
v2 AS (
  SELECT *, {strip("substr(output, p_open + 7, p_close - p_open - 7)")} AS body,
         {strip("CASE WHEN p_close > 0 THEN substr(output, p_close + 8) ELSE output END")} AS tail
  FROM v1),
v3 AS (SELECT *, coalesce({lines('tail')}[-1], '') AS last FROM v2),
v4 AS (SELECT *, starts_with(last, '**Final Answer:**') AS has_final, {strip('substr(last, 18)')} AS val FROM v3),
rules AS (
  SELECT row_idx, 'missing_instruction' AS rule, 1 AS o FROM v4 WHERE ins = ''
  UNION ALL SELECT row_idx, 'legacy_prefix', 2 FROM v4 WHERE ins <> '' AND starts_with(lower(ins), 'return your final response within')
  UNION ALL SELECT row_idx, 'new_question_header', 3 FROM v4 WHERE ins <> '' AND starts_with(lower(ins), 'new question:')
  UNION ALL SELECT row_idx, 'instruction_too_short', 4 FROM v4 WHERE ins <> '' AND length(ins) < 20
  UNION ALL SELECT row_idx, 'missing_output', 5 FROM v4 WHERE outs = ''
  UNION ALL SELECT row_idx, 'no_leading_think', 6 FROM v4 WHERE outs <> '' AND NOT starts_with(lower(first_line), '<think>')
  UNION ALL SELECT row_idx, 'think_count', 7 FROM v4 WHERE outs <> '' AND NOT (n_open = 1 AND n_close = 1)
  UNION ALL SELECT row_idx, 'think_order', 8 FROM v4 WHERE outs <> '' AND n_open = 1 AND n_close = 1 AND p_close < p_open
  UNION ALL SELECT row_idx, 'empty_think', 9 FROM v4 WHERE outs <> '' AND n_open = 1 AND n_close = 1 AND p_close >= p_open AND body = ''
  UNION ALL SELECT row_idx, 'missing_solution', 11 FROM v4 WHERE outs <> '' AND tail = ''
  UNION ALL SELECT row_idx, 'missing_final_line', 12 FROM v4 WHERE outs <> '' AND tail <> '' AND NOT has_final
  UNION ALL SELECT row_idx, 'empty_final_answer', 13 FROM v4 WHERE outs <> '' AND tail <> '' AND has_final AND val = ''
  UNION ALL SELECT row_idx, 'final_not_boxed', 14 FROM v4 WHERE outs <> '' AND tail <> '' AND has_final AND val <> '' AND strpos(val, '\\boxed{{') = 0
  UNION ALL SELECT row_idx, 'final_not_closed', 15 FROM v4 WHERE outs <> '' AND tail <> '' AND has_final AND val <> ''
    AND NOT regexp_matches(val, '\\\\boxed\\{{[\\s\\S]*\\}}\\s*$'))"""


def _rule_messages():
    from evalloop.operators.validate import RULE_MESSAGES
    return RULE_MESSAGES


def q_validate_rows() -> str:
    msgs = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in _rule_messages().items())
    return _with(RAW, VALID_IN) + f"\nSELECT row_idx, rule, CASE rule {msgs} END AS message FROM rules"


def q_validate_summary() -> str:
    return _with(RAW, VALID_IN) + """
SELECT count(*) AS items, count(r.n) AS bad_items, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS error_lines,
       count(*) > 0 AND coalesce(sum(r.n), 0) = 0 AS passed
FROM vin LEFT JOIN (SELECT row_idx, count(*) AS n FROM rules GROUP BY row_idx) r ON vin.row_idx = r.row_idx"""


def q_judge_array_form() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question((8,))) + (
        "\nSELECT judge_key, n_candidates, pass_at_1, pass_at_k FROM pq")


def q_attribution_job() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question((8,))) + """,
c AS (SELECT sample_index, sample_index % 13 = 0 AS failed, sample_index % 3 <> 2 AND sample_index % 13 <> 0 AS parsed
      FROM pq WHERE NOT pass_at_k)
SELECT sample_index, parsed, CASE WHEN parsed THEN 'arithmetic' END AS error_type,
       CASE WHEN parsed THEN 'skill_' || CAST(sample_index % 5 AS VARCHAR) END AS missing_skill,
       CASE WHEN failed THEN 'RuntimeError: refused' END AS error
FROM c"""


def q_generation_job() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question((8,))) + """,
s AS (SELECT sample_index, CAST(x AS INTEGER) AS sample, (5 - (sample_index + x) % 5) % 5 AS a
      FROM pq, (SELECT unnest([0, 1]) AS x) WHERE NOT pass_at_k AND sample_index % 13 <> 0)
SELECT sample_index, sample, a <> 0 AS accepted, CAST(CASE WHEN a = 0 THEN 4 ELSE a END AS INTEGER) AS attempt,
       CASE WHEN a <> 0 THEN 'Variant ' || CAST(sample AS VARCHAR) || ' of order ' || CAST(sample_index AS VARCHAR)
            || ': find the check digit of ' || CAST(sample_index AS VARCHAR) || ' times seven.' END AS instruction
FROM s"""


def q_incremental_judge() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question((8,))) + """
SELECT judge_key, n_candidates, pass_at_1, pass_at_k FROM pq
WHERE sample_index IN (SELECT l_orderkey FROM lineitem)"""


def q_flat_boxed() -> str:
    flat = strip("coalesce(regexp_extract_all(text, '\\\\boxed\\{([^}]*)\\}', 1)[-1], '')")
    return _with(CANDS) + f"\nSELECT sample_index, cand_idx, {flat} AS flat, {boxed('text')} AS balanced FROM cands"


def q_response_text() -> str:
    return """
SELECT event_id,
       CASE WHEN event_id % 3 = 0 AND trim(event_type) <> '' THEN trim(event_type)
            ELSE 'part ' || CAST(user_id AS VARCHAR)
                 || CASE WHEN event_id % 2 = 0 AND trim(event_type) <> '' THEN chr(10) || trim(event_type) ELSE '' END
       END AS text
FROM events"""


def q_recover_user_text() -> str:
    return f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN {strip('text')} ELSE text END AS user_text FROM conversations"


def q_cot_prompts() -> str:
    pr = _prompt_consts()
    cot_head = ("Write a detailed, numbered step-by-step solution inside <think></think> that reaches the "
                "reference answer, then give the boxed answer exactly as given.\n\nProblem:\n")
    ms_head = "Rewrite the solution as alternating <Plan> and <Solve> steps followed by <Answer>.\n\n[Problem]\n"
    return f"""
WITH b AS ({q_benchmark_build()})
SELECT dataset, sample_index,
       {lit(cot_head)} || question || {lit(chr(10) * 2 + 'Reference answer:' + chr(10))} || answer AS cot_prompt,
       {lit(ms_head)} || question || {lit(chr(10) * 2 + '[Original solution]' + chr(10))} || answer AS milestone_prompt,
       CASE WHEN strpos(question, {lit(pr.SECTIONS_INSTRUCTION)}) > 0 THEN question
            WHEN rtrim(question, {WS_CHARS}) <> '' THEN rtrim(question, {WS_CHARS}) || chr(10) || chr(10) || {lit(pr.SECTIONS_INSTRUCTION)}
            ELSE {lit(pr.SECTIONS_INSTRUCTION)} END AS sections_prompt
FROM b"""


def q_dataset_short_names() -> str:
    return """
SELECT 'Org/' || upper(source) AS dataset_id, lower(upper(source)) AS name, count(*) AS n
FROM documents GROUP BY source"""


def q_flat_accuracy() -> str:
    return _with(GOLD, CANDS, VERDICTS) + """
SELECT count(*) AS total, CAST(sum(CAST(final_correct AS INTEGER)) AS DOUBLE) / count(*) AS accuracy FROM verdicts"""


def q_latest_checkpoint() -> str:
    return """
WITH l AS (
  SELECT page_id % 5 AS run,
         CASE WHEN page_id % 7 = 0 THEN 'tmp-' || CAST(page_id AS VARCHAR)
              ELSE 'checkpoint-' || CAST(page_id * 10 AS VARCHAR) END AS name
  FROM pages),
v AS (SELECT run, name, CAST(regexp_extract(name, '^checkpoint-(\\d+)$', 1) AS BIGINT) AS step FROM l
      WHERE regexp_matches(name, '^checkpoint-(\\d+)$'))
SELECT run, arg_max(name, step) AS name, max(step) AS step FROM v GROUP BY run"""


def q_cot_job() -> str:
    nl = "(length({x}) - length(replace({x}, chr(10), '')))"
    n = f"((6 + {nl.format(x='question')} + {nl.format(x='answer')}) % 3)"
    return f"""
WITH b AS ({q_benchmark_build()})
SELECT dataset_id || '::' || CAST(sample_index AS VARCHAR) AS row_idx,
       '<think>' || chr(10) || 'steps (' || CAST({n} AS VARCHAR) || ')' || chr(10) || '</think>' || chr(10)
       || '**Final Answer:** done' AS output,
       'You are a helpful assistant.' AS system
FROM b"""


def q_running_stats() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question((8,))) + """
SELECT CASE WHEN GROUPING(dataset) = 0 THEN 'dataset' ELSE 'overall' END AS scope,
       CASE WHEN GROUPING(dataset) = 0 THEN coalesce(dataset, '') END AS dataset,
       k, count(*) AS n,
       CAST(sum(CAST(pass_at_1 AS INTEGER)) AS DOUBLE) / count(*) AS pass_at_1,
       CAST(sum(CAST(pass_at_k AS INTEGER)) AS DOUBLE) / count(*) AS pass_at_k
FROM pq WHERE sample_index IN (SELECT l_orderkey FROM lineitem)
GROUP BY GROUPING SETS ((k, dataset), (k))"""


def q_provenance() -> str:
    return """
SELECT doc_id, source AS dataset, 'docs/' || source AS dataset_id, CASE source WHEN 'src0' THEN 'hard' ELSE 'easy' END AS difficulty,
       row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS sample_index
FROM documents WHERE source IN ('src0', 'src1')"""


def q_difficulty_preset() -> str:
    return """
SELECT source AS dataset, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS sample_index,
       CASE WHEN source = 'src0' THEN 'hard' ELSE 'unknown' END AS difficulty
FROM documents"""


def q_pick_one() -> str:
    return f"SELECT doc_id, source FROM documents ORDER BY {SEEDED.format(c='doc_id')}, doc_id LIMIT 1"


def q_seeded_shuffle() -> str:
    return """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey * 48271 + 7) % 2147483647, o_orderkey) - 1 AS place
FROM orders"""


def q_missing_shards() -> str:
    return """
SELECT DISTINCT 'shard-' || CAST(l_partkey % 97 AS VARCHAR) AS file FROM lineitem
WHERE l_partkey % 97 NOT IN (SELECT p_partkey % 97 FROM part WHERE p_partkey % 97 < 60)"""


def q_union_columns() -> str:
    return """
SELECT doc_id AS id, lang, CAST(NULL AS INTEGER) AS size FROM documents
UNION ALL SELECT item_id, NULL, CAST(length(text) AS INTEGER) FROM benchmark"""


def q_judged_rows() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question((8,))) + """
SELECT judge_key, n_candidates, pass_at_k FROM pq WHERE n_candidates > 2 AND sample_index % 4 <> 0"""


def q_mixed_k_summary() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question((1, 3, 8))) + """
SELECT count(*) AS count, avg(CAST(pass_at_1 AS INTEGER)) AS pass_at_1, avg(CAST(pass_at_k AS INTEGER)) AS pass_at_k,
       CAST(max(k) AS INTEGER) AS k, count(DISTINCT k) AS n_distinct_k, count(*) FILTER (WHERE k <> n_candidates) AS k_mismatch
FROM pq WHERE k = CASE sample_index % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 8 END"""


def q_stripped_validation() -> str:
    msgs = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in _rule_messages().items())
    return _with(RAW, VALID_IN) + f""",
own AS (
  SELECT row_idx, rule FROM rules WHERE rule NOT IN ('no_leading_think', 'think_count', 'think_order', 'empty_think')
  UNION ALL SELECT row_idx, 'unexpected_think' FROM v4 WHERE outs <> '' AND (strpos(output, '<think>') > 0 OR strpos(output, '</think>') > 0))
SELECT row_idx, rule, CASE rule {msgs} END AS message FROM own"""


def q_tolerant_log() -> str:
    return """
SELECT 'k' || CAST(event_id AS VARCHAR) AS key, CASE WHEN event_id % 14 IN (0, 5, 6) THEN CAST(user_id AS BIGINT) END AS v
FROM events WHERE event_id % 14 IN (0, 1, 5, 6, 7, 8)"""


def q_auto_reader() -> str:
    return """
SELECT CAST(event_id AS BIGINT) AS key, CAST(user_id AS BIGINT) AS v FROM events
WHERE NOT (event_id // 1000 % 2 = 1 AND event_id % 5 = 0)"""


def q_appended_log() -> str:
    return """
SELECT 'k' || CAST(event_id % 997 AS VARCHAR) AS key, CAST(max(event_id) AS BIGINT) AS seq, CAST(max_by(user_id, event_id) AS BIGINT) AS v
FROM events GROUP BY 1"""


def q_manifest() -> str:
    return """
SELECT o_orderpriority AS dataset_name, 'f' || CAST(max(o_orderkey) AS VARCHAR) AS file_name, max(o_orderkey) AS version
FROM orders GROUP BY 1"""


def q_split_choice() -> str:
    return "SELECT doc_id, 'validation' AS split FROM documents WHERE doc_id % 3 = 0"


def q_loop_two_rounds() -> str:
    """Round ``iter`` answers every (iter + 2)-th order with the gold answer; k = 1."""
    return _with(GOLD, CANDS, VERDICTS) + """,
rounds AS (SELECT unnest([0, 1, 2]) AS iter),
firsts AS (
  SELECT iter, CAST(v.final_correct OR (v.sample_index % (iter + 2) = 0 AND v.sample_index IN (SELECT l_orderkey FROM lineitem)) AS INTEGER) AS ok
  FROM verdicts v, rounds WHERE v.cand_idx = 0),
rates AS (SELECT iter, CAST(count(*) AS DOUBLE) AS n, CAST(sum(ok) AS DOUBLE) / count(*) AS rate FROM firsts GROUP BY iter),
long AS (
  SELECT CAST(iter AS INTEGER) AS iter, 'count' AS metric, n AS value FROM rates
  UNION ALL SELECT CAST(iter AS INTEGER), 'pass@1', rate FROM rates
  UNION ALL SELECT CAST(iter AS INTEGER), 'pass@k', rate FROM rates)
SELECT iter, metric, value, lag(value) OVER w AS prev_value, value - lag(value) OVER w AS delta,
       first_value(value) OVER w AS base_value, value - first_value(value) OVER w AS base_delta
FROM long WINDOW w AS (PARTITION BY metric ORDER BY iter)"""


def q_answer_values() -> str:
    return """
WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderkey % 8 AS m FROM orders)
SELECT o_orderkey,
       CASE m WHEN 1 THEN '' WHEN 2 THEN '{"x":' || k || '}' WHEN 4 THEN '[' || k || ',2]' WHEN 5 THEN '' ELSE k END AS "any",
       CASE WHEN m = 1 THEN '' ELSE k END AS boxed,
       CASE m WHEN 0 THEN k WHEN 1 THEN '["' || k || '","2"]' ELSE '' END AS listed,
       CASE WHEN m % 2 = 0 THEN k WHEN m = 1 THEN '{"x":"' || k || '"}' ELSE '' END AS mapped
FROM o"""


def q_prompt_questions() -> str:
    rowjson = "to_json(struct_pack(doc_id := doc_id, problem := problem, question := question, _dataset_id := ident))::VARCHAR"
    return _with(DOC_PROBLEMS) + f""",
p AS (SELECT *, CASE source WHEN 'src0' THEN 'openai/gsm8k' WHEN 'src1' THEN 'HuggingFaceH4/MATH-500' ELSE 'docs' END AS ident FROM rawp)
SELECT doc_id, CASE WHEN source = 'src0' THEN coalesce({nonblank('question')}, {rowjson})
                    ELSE coalesce({nonblank('problem')}, {nonblank('question')}, {rowjson}) END AS asked
FROM p"""


def q_completions_to_predictions() -> str:
    return _with(GOLD, CANDS, VERDICTS) + """,
f AS (SELECT sample_index, string_agg(fa, '|' ORDER BY cand_idx) AS finals FROM pf GROUP BY sample_index)
SELECT g.sample_index, coalesce(f.finals, '') AS finals FROM gold g LEFT JOIN f ON g.sample_index = f.sample_index"""


def q_dataset_full() -> str:
    return f"""
SELECT source AS dataset, doc_id, row_number() OVER (PARTITION BY source ORDER BY {SEEDED.format(c='doc_id')}, doc_id) - 1 AS sample_rank
FROM documents"""


def q_validation_report() -> str:
    return f"SELECT * FROM ({q_validate_rows()}) ORDER BY row_idx, rule LIMIT 20"


def q_redelivered_candidates() -> str:
    return _with(GOLD, CANDS, VERDICTS, per_question((8,))) + "\nSELECT judge_key, n_candidates, pass_at_1, pass_at_k FROM pq"
