"""Quality rules: a decision list learned by sequential covering, emitted as ordered Spark conditions.

Statistics of every text are column expressions.  Rules are conjunctions of thresholds on them.  A rule grows
one condition at a time, by the gain over the labelled documents that no earlier rule covers (two thirds of
them), is pruned from its end on the other third, and joins the list if it is still pure there; else what it
covers is set aside.  The list ends when no condition is worth its description.  What is counted is a table of labelled cells (documents that fall between the same
thresholds, good and bad): every step is one grouped count over it, and only counts per statistic and
threshold reach the driver, never documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloop.llm.common import BROADCAST_ROWS, cut_lineage
from evalloop.llm.expressions import let, total

WINDOW = 5
#: Tries after which the cells that are still open are stored anew.
ROUNDS = 16
#: Base limits: fewer words, or a larger percentage of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 10, 20

_SHARES = [0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.075, 0.1, 0.125, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45,
           0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
#: The thresholds that a rule can use, by statistic.
GRID: dict[str, list[float]] = {
    "repeated": _SHARES, "symbols": _SHARES, "capitals": _SHARES, "marks": _SHARES, "distinct": _SHARES,
    "same_lines": _SHARES, "word_length": [1 + k / 2 for k in range(30)],
    "n_words": [float(round(10 * 1.5 ** k)) for k in range(20)],
}


@dataclass(frozen=True)
class Condition:
    """``statistic > grid[at]`` if ``above``, else ``statistic <= grid[at]``."""

    statistic: str
    at: int
    above: bool

    def column(self) -> Column:
        x, edge = F.col(self.statistic), F.lit(GRID[self.statistic][self.at])
        return F.coalesce(x > edge if self.above else x <= edge, F.lit(False))

    def over_cells(self) -> Column:
        x = F.get(F.col("cell"), F.lit(list(GRID).index(self.statistic)))
        return x > self.at if self.above else x <= self.at

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {GRID[self.statistic][self.at]:g}"


Rule = tuple[Condition, ...]


def _without(text: Column, chars: str) -> Column:
    """How many characters of ``text`` match the class."""
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more.

    Windows are compared by a 64-bit hash of their words.  Texts whose hashes are all distinct are done; for the
    others the hashes are sorted with their places, equal neighbours mark their places, and the windows at
    the marked places are laid over each other.
    """
    hashes = F.when(F.size(words) >= WINDOW, F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)])))

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        marked = let(ranked, lambda s: F.transform(F.filter(s, lambda x, k: F.coalesce(
            x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))),
            lambda x: x["i"]))
        return let(F.array_sort(marked), lambda p: total(F.transform(p, lambda x, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("long"))))

    return F.coalesce(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h))), F.lit(0).cast("long"))


def statistics(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Base counts and the statistics of the grid for every row, beside the columns ``keep``.

    A null text has no word.  Statistics that divide by nothing are null, and no condition holds for null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c.alias(f"_keep{k}") for k, c in enumerate(keep or [])]
    df = docs.select(*kept, text.alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""))
    df = df.withColumn("_joined", F.array_join("_words", ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    size = lambda c: F.size(c).cast("long")
    df = df.select(
        *[f"_keep{k}" for k in range(len(kept))],
        size("_words").alias("n_words"), F.length("_joined").cast("long").alias("word_chars"),
        _without(F.col("_joined"), r"[#*$%&|<>]").alias("n_symbols"),
        (size("_lines") - size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _repeated_words(F.col("_words")).alias("n_repeat_words"),
        _without(F.col("_joined"), r"\p{Lu}").alias("_capitals"), _without(F.col("_joined"), "[!?]").alias("_marks"),
        size(F.array_distinct("_words")).alias("_distinct"), size("_lines").alias("_n_lines"))
    words, chars = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("word_chars"), F.lit(0))
    return df.select(
        *[f"_keep{k}" for k in range(len(kept))],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        (F.col("n_repeat_words") / words).alias("repeated"), (F.col("n_symbols") / chars).alias("symbols"),
        (F.col("_capitals") / chars).alias("capitals"), (F.col("_marks") / chars).alias("marks"),
        (F.col("_distinct") / words).alias("distinct"), (F.col("word_chars") / words).alias("word_length"),
        (F.col("n_dup_lines") / F.nullif(F.col("_n_lines"), F.lit(0))).alias("same_lines"))


def cells(labelled: DataFrame, bad: str = "bad", fold_by: str = "fold_by") -> DataFrame:
    """Labelled statistics as counts: ``cell`` (per statistic, how many thresholds lie below it), ``prunes``, ``good``, ``bad``."""
    def place(name: str) -> Column:
        edges = F.array(*map(F.lit, GRID[name]))
        return F.size(F.filter(edges, lambda e: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) > e))

    return labelled.select(
        F.array(*map(place, GRID)).alias("cell"),
        (F.pmod(F.xxhash64(fold_by), F.lit(3)) == 0).alias("prunes"), F.col(bad).alias("_bad")).groupBy("cell", "prunes").agg(
        F.sum(F.when(F.col("_bad") == 0, 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("_bad") == 1, 1).otherwise(0)).alias("bad"))


def _all(conditions) -> Column:
    held = F.lit(True)
    for c in conditions:
        held &= c.over_cells()
    return held


def _counts(df: DataFrame) -> dict[str, list[tuple[int, int]]]:
    """Good and bad documents of the grown part per statistic and place: at most thresholds + 1 rows a statistic."""
    rows = df.select("good", "bad", F.posexplode("cell").alias("k", "at")).groupBy("k", "at").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    names = list(GRID)
    out = {n: [(0, 0)] * (len(GRID[n]) + 1) for n in names}
    for r in rows:
        out[names[r["k"]]][r["at"]] = (r["good"], r["bad"])
    return out


def _saved(bad: int, good: int, all_bad: int, all_good: int) -> float:
    """Bits that a rule saves on the bad documents it covers, against the share of bad ones among all."""
    return bad * (math.log2((bad + 1) / (bad + good + 2)) - math.log2((all_bad + 1) / (all_bad + all_good + 2)))


def _best(counts: dict[str, list[tuple[int, int]]], cost: float, least_bad: int) -> tuple[float, Condition | None, int]:
    """The condition that saves most bits beyond ``cost`` and leaves ``least_bad`` bad documents, and how many good ones it leaves."""
    good, bad = (sum(x[k] for x in next(iter(counts.values()))) for k in (0, 1))
    top: tuple[float, Condition | None, int] = (cost, None, good)
    for name, places in counts.items():
        g = b = 0
        for at in range(len(places) - 1):
            g, b = g + places[at][0], b + places[at][1]
            for above, gg, bb in ((False, g, b), (True, good - g, bad - b)):
                gain = _saved(bb, gg, bad, good)
                if bb >= least_bad and gain > top[0]:
                    top = gain, Condition(name, at, above), gg
    return top


def learn(stats: DataFrame, purity: float = 0.85, least_bad: int = 4) -> list[Rule]:
    """Rules that recognise bad documents, in order, from a stored table of ``cells``.

    A condition joins a rule if it saves more bits on the bad documents than it takes to name one of the
    thresholds, and leaves ``least_bad`` of them.  A rule is kept if the smoothed share of bad documents among those it covers
    in the pruning part is at least ``purity``, it covers at least ``least_bad`` bad ones there, and saves more bits
    than it takes to number the tries so far.  The bad documents of a rule that fails are set aside: later rules do not
    seek them, while the good ones beside them still count against every rule.  The list ends when no condition
    saves its own bits, so neither rules nor conditions are limited in number; every try sets documents aside or
    covers them, so there are at most as many tries as bad documents / ``least_bad``.  Without labels the list is empty.
    """
    rules: list[Rule] = []
    open_cells, sought, tries = F.lit(True), F.lit(True), 0
    cost = math.log2(2 * sum(map(len, GRID.values())))
    while True:
        tries += 1
        rest = stats.filter(open_cells).withColumn("sought", F.when(sought, F.col("bad")).otherwise(0))
        grown: list[Condition] = []
        while True:
            seen = rest.filter(~F.col("prunes") & _all(grown)).select("cell", "good", F.col("sought").alias("bad"))
            _, condition, good = _best(_counts(seen), cost, least_bad)
            if condition is None:
                break
            grown.append(condition)
            if not good:
                break
        if not grown:
            return rules
        sums = [F.sum(F.when(_all(grown[:k]), F.col(c)).otherwise(0)).alias(f"{c}{k}")
                for k in range(len(grown) + 1) for c in ("good", "bad")]
        row = rest.filter("prunes").agg(*sums).first()
        held = [((row[f"bad{k}"] or 0), (row[f"good{k}"] or 0)) for k in range(len(grown) + 1)]
        keep = max(range(1, len(held)), key=lambda k: ((held[k][0] - held[k][1]) / max(1, sum(held[k])), held[k][0], -k))
        (bad, good), saved = held[keep], _saved(*held[keep], *held[0])
        if bad >= least_bad and (bad + 1) / (bad + good + 2) >= purity and saved > math.log2(tries):
            rules.append(tuple(grown[:keep]))
            open_cells &= ~_all(rules[-1])
        else:
            sought &= ~_all(grown)
        if tries % ROUNDS == 0:  # the masks of many tries would make the plan long
            stats = cut_lineage(stats.filter(open_cells).withColumn("sought", sought), "quality-open")
            open_cells, sought = F.lit(True), F.col("sought")


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional over ``statistics``: true if a document is kept."""
    out = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        held = F.lit(True)
        for c in rule:
            held &= c.column()
        out = out.when(held, F.lit(False))
    return out.otherwise(F.lit(True))


def labelled_cells(stats: DataFrame, labels: DataFrame, id_col: str, label_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Cells of the documents that pass the base limits and have a label (the worst, if a label repeats)."""
    marks = labels.filter(F.col(quality).isNotNull() & F.col(label_id).isNotNull()).groupBy(
        F.col(label_id).alias("_label_id")).agg((1 - F.min(quality)).alias("bad"))
    names = list(dict.fromkeys([*GRID]))
    joined = stats.filter(~F.col("base_failed")).select(F.col(id_col).alias("fold_by"), *names).join(
        marks, F.col("fold_by") == F.col("_label_id"))
    return cut_lineage(cells(joined), "quality-cells")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """``id_col``, the base counts, ``base_failed`` and ``kept`` of every row; and the rules.

    One pass over the texts; its narrow result is stored and serves learning and judging.  A null or empty text
    has no words and fails; rows that repeat an id are judged one by one; rows with a null id are judged but
    never learned from; without labels only the base limits hold; an empty table gives an empty result;
    other columns are not read.
    """
    stats = cut_lineage(statistics(docs, text_col, [F.col(id_col)]).withColumnRenamed("_keep0", "_id"), "quality-statistics")
    rules = learn(labelled_cells(stats, labels, "_id"))
    judged = stats.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                          "n_repeat_words", "base_failed", verdict(rules).alias("kept"))
    return judged, rules


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``judge`` would not keep, with all its columns.

    Rules are learned from the statistics of the labelled rows alone; then each row is judged by its own text in one pass
    over all, so nothing is joined back to the texts.  Null and empty texts have no words and go; rows that repeat an id
    are judged one by one; rows with a null id are judged but never learned from; an empty table gives an empty result.
    """
    named = cut_lineage(labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_label_id")).distinct(), "quality-label-ids")
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))
    if named.count() <= BROADCAST_ROWS:
        read = read.join(F.broadcast(named), F.col("_id") == F.col("_label_id"), "left_semi")
    # beyond that the texts would be shuffled for the join: their statistics are joined instead
    stats = cut_lineage(statistics(read, "_body", [F.col("_id")]).withColumnRenamed("_keep0", "_id"), "quality-statistics")
    rules = learn(labelled_cells(stats, labels, "_id"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text_col).alias("_body"))
    judged = statistics(whole, "_body", [F.col("_doc")])
    # not a filter: pushed below the statistics, it would hold a copy of them for every condition that names one
    return judged.select(F.explode(F.when(verdict(rules), F.array("_keep0"))).alias("_doc")).select("_doc.*")
