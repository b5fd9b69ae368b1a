"""URL filter: a tree of path templates per host, rejected by the purity of their labelled pages; columns only.

Runs of digits in a path are generalised first.  Then the tree is walked from the host down: below each node, a
segment stays literal only if enough pages have it and their labels differ from those of its siblings taken
together; all other segments (the variable ones and the branches that are statistically alike) become the
wildcard.  Every node, inner or leaf, sums its labels; its purity is smoothed towards that of the node above
it, the host's towards all pages.  A page takes the verdict of the deepest node on its path that has enough
labels.  A node with too few labels to change a verdict below it is not walked further, and segments that all
pages of a node share are passed in one step, so no depth is set.  Hand-written rules come before the tree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloop.llm.common import cut_lineage, small_side

#: Pages and labelled pages that a literal branch needs, and how many standard errors it lies off its siblings.
LEAST_PAGES, LEAST_LABELS, APART = 20, 8, 3.0
#: Pseudo-labels of the node above (for a host, of all pages) in a purity, and the purity below which a node is rejected.
PRIOR, PURITY = 10.0, 0.5


@dataclass(frozen=True)
class Rule:
    """``place`` is a host and the start of a path, like ``example.net/en/``; it holds for all subdomains."""

    place: str
    verdict: str

    def fits(self) -> Column:
        host, _, path = self.place.partition("/")
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> list[Column]:
    """``host`` (A-Z lower-cased) and ``path``; both empty for a null url and one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return [F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower()).alias("host"),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path")]


def shape(path: Column) -> Column:
    """The path with long hexadecimal names and runs of digits generalised."""
    hexes = F.regexp_replace(path, r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{8}[0-9a-fA-F-]{8,}(?![0-9A-Za-z])", "{x}")
    return F.regexp_replace(hexes, r"[0-9]+", "{n}")


#: Stands for the end of a path among the segments below a node; no segment holds a slash.
END = "/"


def _wild(segment: Column) -> Column:
    """The wildcard; an empty segment (and the end of a path) is no variable."""
    return F.when(segment.isin("", END), segment).otherwise(F.lit("*"))


def _below(template: Column, segments: Column) -> Column:
    """``template`` with all ``segments`` generalised below it."""
    return F.concat(template, F.array_join(F.transform(segments, lambda x: F.concat(F.lit("/"), _wild(x))), ""))


def _shared(low: Column, high: Column) -> Column:
    """How many first segments the smallest and the largest of some paths share, and so all between them."""
    most = F.least(F.size(low), F.size(high))
    same = F.when(most > 0, F.transform(F.sequence(F.lit(0), F.greatest(most, F.lit(1)) - 1), lambda k: F.get(low, k) == F.get(high, k)))
    differs = F.coalesce(F.array_position(same, False), F.lit(0))
    return F.when(differs > 0, differs - 1).otherwise(most).cast("int")


def _tail(segments: Column, count: Column) -> Column:
    return F.slice(segments, count + 1, F.greatest(F.size(segments) - count, F.lit(0)))


def templates(shapes: DataFrame, least_pages: int = LEAST_PAGES, least_labels: int = LEAST_LABELS, apart: float = APART,
              prior: float = PRIOR, purity: float = PURITY) -> DataFrame:
    """``host``, ``shape``, ``template`` and ``out`` (rejected) of ``shapes`` (a stored table of host, shape, n, good, bad).

    A step is a grouped count of the children of all open nodes, one of their parents, and joins with tables
    of nodes; hosts and branches with a third of all pages are counted on the map side first.  A node is open while it
    has more than ``least_labels`` labels: with fewer, no segment below it can be literal, and a node below it has either
    all its labels, and so its purity, or too few.  Steps end when no node is open: there are at most as many as places
    where the paths of an open node part.
    """
    sums = lambda: [F.sum(c).alias(c) for c in ("good", "bad")]
    ranges = lambda low, high: [F.min(low).alias("low"), F.max(high).alias("high")]
    tail = F.split("shape", "/")
    rows = shapes.select("host", "shape", "n", "good", "bad", F.lit("").alias("template"), _tail(tail, F.lit(1)).alias("tail"))
    hosts = cut_lineage(rows.groupBy("host").agg(*sums(), *ranges("tail", "tail")), "url-hosts")
    good, bad = hosts.agg(F.sum("good"), F.sum("bad")).first()
    overall = (good + 1) / (good + bad + 2) if good is not None else 0.5

    def nodes(df: DataFrame, above: Column, inherits: Column, out: Column) -> DataFrame:
        """Purity and verdict of nodes, whether they are open, and how many segments their pages share."""
        labels = F.col("good") + F.col("bad")
        pure = F.when(inherits, above).otherwise((F.col("good") + prior * above) / (labels + prior))
        return df.withColumn("pure", pure).select(
            "*", F.when(labels >= least_labels, F.col("pure") < purity).otherwise(out).alias("out"),
            (labels > least_labels).alias("open"), _shared(F.col("low"), F.col("high")).alias("shared"))

    def enter(df: DataFrame, node: DataFrame, keys: list[str]) -> DataFrame:
        """Rows with their node's verdict; those of open nodes go on below the segments that all its pages share."""
        own = node.select(*keys, F.col("good").alias("node_good"), F.col("bad").alias("node_bad"), "pure", "out", "open", "shared")
        met = df.join(small_side(own), keys)
        steps = F.when(F.col("open"), F.col("shared")).otherwise(F.size("tail"))
        return met.withColumn("template", _below(F.col("template"), F.slice("tail", F.lit(1), steps))).withColumn(
            "tail", _tail(F.col("tail"), steps))

    root = cut_lineage(nodes(hosts, F.lit(overall), F.lit(False), F.lit(False)), "url-roots")
    now = cut_lineage(enter(rows, root, ["host"]), "url-level")
    done = []
    while True:
        done.append(now.filter(~F.col("open")).select("host", "shape", "template", "out"))
        going = now.filter("open")
        if going.isEmpty():
            break
        segment = F.coalesce(F.get("tail", F.lit(0)), F.lit(END))
        rest = _tail(F.col("tail"), F.lit(1))
        of_node = ["node_good", "node_bad", "pure", "out"]
        kids = cut_lineage(going.groupBy("host", "template", segment.alias("segment"), *of_node).agg(
            F.sum("n").alias("n"), *sums(), *ranges(rest, rest)), "url-kids")
        pool = cut_lineage(kids.filter(F.col("segment") != END).groupBy("host", "template").agg(
            F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad")), "url-parents")
        own, others = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad") - F.col("good") - F.col("bad")
        pooled = F.col("all_bad") / (F.col("all_good") + F.col("all_bad"))
        error = F.sqrt(pooled * (1 - pooled) * (1 / own + 1 / others))
        differ = F.abs(F.col("bad") / own - (F.col("all_bad") - F.col("bad")) / others) > apart * error
        # divisions by zero are never reached: labels of its own and beside it come first
        literal = F.when((F.col("n") >= least_pages) & (own >= least_labels) & (others > 0) & ~F.col("segment").isin("", END),
                         differ).otherwise(False)
        named = cut_lineage(kids.join(small_side(pool), ["host", "template"], "left").withColumn(
            "name", F.when(literal, F.col("segment")).otherwise(_wild(F.col("segment")))).drop("n", "all_good", "all_bad"), "url-named")
        below = named.groupBy("host", "template", "name", F.col("node_good"), F.col("node_bad"), F.col("pure").alias("above"),
                              F.col("out").alias("above_out")).agg(*sums(), *ranges("low", "high"))
        same = (F.col("good") == F.col("node_good")) & (F.col("bad") == F.col("node_bad"))
        child = nodes(below.drop("pure", "out"), F.col("above"), same, F.col("above_out"))
        child = cut_lineage(child.withColumn("open", F.col("open") & (F.col("name") != END)), "url-children")
        kept = cut_lineage(named.filter(F.col("name") == F.col("segment")).filter(~F.col("segment").isin("", END)).select(
            "host", "template", "segment", F.col("segment").alias("kept")), "url-literals")
        moved = going.drop("node_good", "node_bad", "pure", "out", "open", "shared").withColumn("segment", segment).join(
            small_side(kept), ["host", "template", "segment"], "left")
        moved = moved.withColumn("name", F.coalesce("kept", _wild(F.col("segment")))).withColumn("tail", rest)
        keyed = child.withColumnRenamed("template", "up")
        moved = moved.withColumnRenamed("template", "up").withColumn(
            "template", F.when(F.col("name") == END, F.col("up")).otherwise(F.concat("up", F.lit("/"), "name")))
        now = cut_lineage(enter(moved, keyed, ["host", "up", "name"]).drop("up", "name", "segment", "kept"), "url-level")
    return reduce(DataFrame.unionByName, done)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", bad_col: str | None = "bad",
          rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``template`` of every row.

    ``bad_col``: 1 for a page labelled bad, 0 for good, null without a label.  The verdict is that of the
    longest rule that fits, else block below rejected nodes and allow for all others; without labels nothing is
    rejected.  Null urls and urls without ``://`` have an empty host and path; ids may be null
    or repeat; an empty table gives an empty result; other columns are not read.
    """
    bad = F.col(bad_col) if bad_col else F.lit(None).cast("int")
    rows = pages.select(F.col(id_col).alias("id"), *host_and_path(F.col(url_col)), bad.alias("mark"))
    rows = cut_lineage(rows.withColumn("shape", shape(F.col("path"))), "url-pages")
    shapes = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("mark") == 0, 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("mark") == 1, 1).otherwise(0)).alias("bad"))
    judged = cut_lineage(templates(cut_lineage(shapes, "url-shapes")), "url-judged")
    first = F.lit(None).cast("string")
    verdict = F.when(F.col("out"), F.lit("block")).otherwise(F.lit("allow"))
    for r in sorted(rules, key=lambda r: len(r.place)):
        first, verdict = F.when(r.fits(), F.lit(r.place)).otherwise(first), F.when(r.fits(), F.lit(r.verdict)).otherwise(verdict)
    return rows.join(small_side(judged), ["host", "shape"]).select(
        F.col("id").alias(id_col), "host", "path", first.alias("rule"), verdict.alias("verdict"), "template")
