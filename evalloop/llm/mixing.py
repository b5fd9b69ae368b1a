"""Mixing sources to target weights: weighted sampling by exponential keys, cut at token budgets.

Every document draws an exponential key, divided by its quality weight (Efraimidis and Spirakis); a source's
documents, sorted by key, are taken until their sizes reach the source's budget.  Complete epochs over a source
come first, the rest of its target is the fractional selection.  The order within a source is found
without sorting it in one place: keys fall into equal shares of the key distribution, the sizes of the shares are
summed first, and only the share in which the budget ends is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloop.llm.common import WORD, cut_lineage, small_side

#: Shares into which the keys of a source fall; the one in which a budget ends is sorted as a whole.
SHARES = 4096
WEIGHTS = (3, 1, 2)
#: Percent of all sizes that the mix holds.
TOTAL_PERCENT = 150
MOST_EPOCHS = 2
#: Quality weights of labelled documents; others weigh 1.
QUALITY_WEIGHT = {1: 2.0, 0: 0.5}


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: Column, text: Column, weight: Column, seed: int) -> Column:
    """The exponential key of a document over its weight; equal documents draw equal keys (see :func:`_numbered`)."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    unit = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(unit) / weight


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total_percent: int = TOTAL_PERCENT,
            most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``sizes`` (source, size: a row per source) with ``target``, the words each source gives to the mix.

    Sources in order of their code points, null last, weigh ``weights`` in turn.  A target stops at
    ``most_epochs`` times the size; what is above is shared again by weight among the others until none is above.
    In closed form: in order of size per weight, a source is full if the share of what is left at its turn is
    at least its limit.  A table with one narrow row per source is sorted as a whole.
    """
    every = Window.orderBy(F.col("source").isNull(), F.col("source"))
    order = Window.orderBy(F.col("size") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    df = sizes.withColumn("w", F.get(F.array(*map(F.lit, weights)), turn).cast("long"))
    # left / (100 * open_w) words per unit of weight are left when a source's turn comes
    left = (total_percent * F.sum("size").over(Window.partitionBy())
            - 100 * most_epochs * F.coalesce(F.sum("size").over(before), F.lit(0)))
    df = df.withColumn("left", left).withColumn("open_w", F.sum("w").over(rest))
    df = df.withColumn("full", 100.0 * most_epochs * F.col("size") * F.col("open_w") <= F.col("left").cast("double") * F.col("w"))
    first = F.min(F.when(~F.col("full"), F.struct(F.col("size") / F.col("w"), F.col("source").isNull(), F.col("source"),
                                                  F.col("left").alias("left"), F.col("open_w").alias("open_w")))).over(
        Window.partitionBy())
    df = df.withColumn("first", first)
    shared = F.col("w") * F.col("first.left") / (100 * F.col("first.open_w"))
    return df.select("source", "size", F.when(F.col("full"), (most_epochs * F.col("size")).cast("double")).otherwise(
        shared).alias("target"))


def _share(key: Column) -> Column:
    return F.floor(F.least(F.lit(1.0), 1 - F.exp(-key)) * SHARES).cast("int")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def plan(sized: DataFrame) -> DataFrame:
    """Per source (as ``of``) its size, target, complete epochs, and the share and key at which the rest of its target ends.

    ``sized``: a stored table of source, size, key.  The document at which the budget ends is taken if that
    brings the source nearer to its target.  Where several rows have the last key, ``last_start`` is what the
    source's rows before them hold, so that the budget ends among them.
    """
    shared = sized.withColumn("share", _share(F.col("key")))
    shares = cut_lineage(shared.groupBy("source", "share").agg(F.sum("size").alias("size")), "mix-shares")
    goals = targets(shares.groupBy("source").agg(F.sum("size").alias("size")))
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("size"), F.lit(0))), F.lit(0)).cast("long")
    goals = goals.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", epochs.alias("epochs"))
    goals = cut_lineage(goals.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-goals")
    run = Window.partitionBy("source").orderBy("share")
    sums = shares.withColumn("upto", F.sum("size").over(run)).withColumn("before", F.col("upto") - F.col("size"))
    # the first share whose end reaches the budget; a budget is below the size of its source
    last = sums.join(small_side(goals), _same("source", "of")).filter(
        (F.col("budget") > 0) & (F.col("upto") >= F.col("budget"))).groupBy("of").agg(
        F.min(F.struct("share", "before", "budget")).alias("x"))
    last = cut_lineage(last.select("of", F.col("x.share").alias("last_share"), "x.before", "x.budget"), "mix-last-shares")
    inside = shared.join(small_side(last), _same("source", "of") & (F.col("share") == F.col("last_share"))).groupBy(
        "of", "budget", "before", "key").agg(F.sum("size").alias("size"), F.count("*").alias("tied"))
    ordered = Window.partitionBy("of").orderBy("key")
    start = F.col("before") + F.sum("size").over(ordered) - F.col("size")
    begun = F.col("start") + F.col("size") / F.col("tied") / 2 <= F.col("budget")
    cut = inside.withColumn("start", start).filter(begun).groupBy(F.col("of").alias("cut_of")).agg(
        F.max(F.struct("key", "start")).alias("x")).select("cut_of", F.col("x.key").alias("last_key"), F.col("x.start").alias("last_start"))
    last = last.select(F.col("of").alias("last_of"), "last_share")
    return cut_lineage(goals.join(last, _same("of", "last_of"), "left").join(cut, _same("of", "cut_of"), "left").select(
        "of", "source_size", "target", "budget", "epochs", "last_share", "last_key", "last_start"), "mix-plan")


def _tied() -> Column:
    return F.coalesce(F.col("key") == F.col("last_key"), F.lit(False))


def _copies(nth: Column | None = None) -> Column:
    """How often a row is taken; ``nth``: its number among those that tie at the last key, null for the others."""
    taken = (F.col("share") < F.col("last_share")) | ((F.col("share") == F.col("last_share")) & (F.col("key") < F.col("last_key")))
    if nth is not None:
        taken = F.col("last_start") + (nth - 1) * F.col("size") + F.col("size") / 2 <= F.col("budget")
    return F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("long")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` that tie at the last key of their source (as ``of``), stored and numbered as ``nth`` from 1.

    They are equal in id and text, so it does not matter which of them are taken.  A source of copies is counted per
    stored part first; only the numbers within a part are found by sorting.
    """
    # the place of a row: the task that stored it, then its number there
    rows = cut_lineage(rows.withColumn("_place", F.monotonically_increasing_id()), "mix-ties").withColumn(
        "_part", F.shiftright("_place", 33))
    sums = rows.groupBy(F.col("of").alias("_of"), F.col("_part").alias("_sum_part")).count().withColumn(
        "_before", F.sum("count").over(Window.partitionBy("_of").orderBy("_sum_part")) - F.col("count"))
    sums = small_side(cut_lineage(sums.drop("count"), "mix-tie-parts"))
    local = F.row_number().over(Window.partitionBy("of", "_part").orderBy("_place"))
    return rows.withColumn("_local", local).join(sums, _same("of", "_of") & (F.col("_part") == F.col("_sum_part"))).withColumn(
        "nth", F.col("_before") + F.col("_local"))


def _keyed(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, keep: list[Column]) -> DataFrame:
    """``keep``, source and key of every row; labels (doc_id, quality) give the weights, the worst if one repeats."""
    worst = cut_lineage(labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(
        F.min("quality").alias("_quality")), "mix-labels")
    rows = docs.select(*keep, F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
                       draw(F.col(id_col), F.col(text_col), F.lit(1.0), seed).alias("_draw"))
    weight = F.lit(1.0)
    for mark, w in QUALITY_WEIGHT.items():
        weight = F.when(F.col("_quality") == mark, F.lit(w)).otherwise(weight)
    names = rows.columns[:len(keep)]
    return rows.join(small_side(worst), F.col("_id") == F.col("_label_id"), "left").select(
        *names, "source", (F.col("_draw") / weight).alias("key"))


def _sized(docs, labels, id_col, text_col, source_col, seed) -> DataFrame:
    keep = [F.col(id_col).alias("id"), size_in_words(F.col(text_col)).alias("size")]
    return cut_lineage(_keyed(docs, labels, id_col, text_col, source_col, seed, keep), "mix-sizes")


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 42) -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target`` and ``taken`` of every row.

    Documents are taken whole, at most ``MOST_EPOCHS`` times; a source's taken words differ from its target by at
    most half the size of the document at which its budget ends.  Rows that are equal in id and text draw
    the same key; where the budget ends among them, so many of them are taken as it needs.  Null and empty texts have
    size 0; a null source is a source of its own; an empty table gives an empty result; other columns are not read.
    """
    rows = _sized(docs, labels, id_col, text_col, source_col, seed)
    rows = rows.withColumn("share", _share(F.col("key"))).join(small_side(plan(rows)), _same("source", "of"))
    out = lambda df, copies: df.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"))
    return out(rows.filter(~_tied()), _copies()).unionByName(out(_numbered(rows.filter(_tied())), _copies(F.col("nth"))))


def mixed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: int = 42) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as ``mix`` takes it.

    A row's key is compared with the last key of its source, so the texts are not sorted; they are shuffled only
    where the labels are too many to be broadcast.  Null and empty texts, null ids and sources and an empty table are
    treated as by :func:`mix`; of rows equal in id and text that tie at the budget's end, any are taken.
    """
    goals = small_side(plan(_sized(docs, labels, id_col, text_col, source_col, seed)))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = _keyed(docs, labels, id_col, text_col, source_col, seed, [whole, size_in_words(F.col(text_col)).alias("size")])
    rows = rows.withColumn("share", _share(F.col("key"))).join(goals, _same("source", "of"))
    out = lambda df, copies: df.select("_doc", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("_doc.*")
    return out(rows.filter(~_tied()), _copies()).unionAll(out(_numbered(rows.filter(_tied())), _copies(F.col("nth"))))
