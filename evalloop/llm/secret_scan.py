"""Secrets in texts: known forms by pattern, unknown ones by sliding-window entropy; column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloop.llm.expressions import let, running_sum

#: The base patterns in the order in which equal starts are listed.
PATTERNS = {
    "assign": r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
#: The value of an assignment has at least so many characters; shorter ones are matched and then dropped.
LEAST_VALUE = 8

#: Candidate strings of the method: runs of these characters that hold a digit and a letter.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
WIDTH = 20
#: Bits per character that the densest window needs, by the string's character class: the 0.1 % quantile of one
#: window of random characters, of 16 (hexadecimal), 32 (base32, the smaller single-case alphabet) and 58 (base58) kinds.
ENTROPY = {"hexadecimal": (r"^[0-9A-F]+$|^[0-9a-f]+$", 2.70), "single case": (r"^[^a-z]+$|^[^A-Z]+$", 3.17), "mixed": (r"", 3.44)}
#: Placeholder words: they part a candidate, and what lies on either side is judged for itself.
PLACEHOLDER = r"(?i)example|placeholder|changeme|dummy|x{6,}|0{8,}|12345678"
#: Harmless strings: UUIDs, names with a counter behind, names in camel case with numbers, hyphenated words and paths.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
NAME_PART = r"[-_/=]?(?:[A-Z][a-z]+|[a-z]{2,}|[A-Z]{2,})"
CAMEL_PART = r"-?(?:[A-Z][a-z]{2,}|[A-Z][a-z](?=[A-Z][a-z]{2})|[0-9]{1,4}+(?![0-9]))"
PATH_PART = r"^(?:[A-Za-z]{1,24}|[0-9]{1,8})$"
SEPARATORS = r"[-_/=+]+"


def _plus(c: Column) -> Column:
    """c log2 c, zero at nothing."""
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(candidate: Column, width: int = WIDTH) -> Column:
    """The largest Shannon entropy, in bits per character, of the windows of ``width`` characters.

    One pass: the counts of the window's characters and the sum of c log2 c over them are carried along; a step
    counts one character in and one out.
    """
    letters = F.array(*map(F.lit, ALPHABET))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def over(places: Column) -> Column:
        def shift(n: Column, s: Column, at: Column, by: int) -> Column:
            c = F.get(n, at)
            return F.struct(F.transform(n, lambda x, k: F.when(k == at, x + by).otherwise(x)).alias("n"),
                            (s + _plus(c + by) - _plus(c)).alias("s"))

        def step(acc: Column, i: Column) -> Column:
            more = shift(acc["n"], acc["s"], F.get(places, i), 1)
            less = let(more, lambda m: F.when(i >= width, shift(m["n"], m["s"], F.get(places, i - width), -1)).otherwise(m))
            return let(less, lambda m: F.struct(
                m["n"].alias("n"), m["s"].alias("s"),
                F.when(i >= width - 1, F.greatest(acc["best"], math.log2(width) - m["s"] / width)).otherwise(
                    acc["best"]).alias("best")))

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step, lambda acc: acc["best"])

    codes = F.transform(F.split(candidate, ""), lambda c: (F.array_position(letters, c) - 1).cast("int"))
    return let(codes, over)


def _allowed(value: Column) -> Column:
    """Harmless strings of any length.

    Parts are replaced or split off one after another and what remains is tested: a pattern that repeats a group over the
    whole string would take a stack frame per part.
    """
    mark = "\u0001"
    named = F.regexp_replace(value, NAME_PART, mark).rlike(f"^{mark}+[-_/=]?[0-9]{{1,10}}$")
    level = F.regexp_replace(value, SEPARATORS, "-")
    camel = F.regexp_replace(F.regexp_replace(level, "^[a-z]+", ""), CAMEL_PART, mark).rlike(f"^{mark}+-?$")
    path = let(F.split(F.regexp_replace(level, "-$", ""), "-", -1), lambda found: (F.size(found) > 1) & F.forall(found, lambda x: x.rlike(PATH_PART)))
    return value.rlike(UUID) | ((F.length(value) >= WIDTH) & (named | camel)) | path


def _dense(value: Column) -> Column:
    least = F.lit(None)
    for pattern, bits in reversed(ENTROPY.values()):
        least = F.when(value.rlike(pattern), F.lit(bits)).otherwise(least) if pattern else F.lit(bits)
    return window_entropy(value) >= least


def _suspicious(candidate: Column) -> Column:
    """What lies between placeholder words, with and without a cut at ``=`` (a name before a value), is judged."""
    parts = F.array_distinct(F.concat(F.split(candidate, PLACEHOLDER, -1), F.split(candidate, PLACEHOLDER + "|=+", -1)))
    return ~_allowed(candidate) & F.exists(parts, lambda p: (F.length(p) >= WIDTH) & ~_allowed(F.ltrim(p, F.lit("-_/=+"))) & _dense(p))


_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _found(text: Column, kind: str, rank: int, pattern: str, passes) -> Column:
    """Spans of the leftmost non-overlapping matches that ``passes`` accepts; places in code points, end exclusive.

    Splitting gives what lies between the matches; the running sum of the lengths of both gives the places.
    """
    def place(pieces: Column, hits: Column) -> Column:
        steps = F.transform(hits, lambda h, k: (F.length(F.get(pieces, k)) + F.length(h)).cast("long"))
        return let(running_sum(steps), lambda ends: F.filter(F.transform(hits, lambda h, k: F.struct(
            (F.get(ends, k) - F.length(h)).alias("start"), F.lit(rank).alias("rank"),
            F.when(passes(h, k), F.lit(kind)).alias("kind"), F.get(ends, k).alias("end"))), lambda s: s["kind"].isNotNull()))

    spans = let(F.split(text, pattern, -1), lambda pieces: let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: place(pieces, hits)))
    return F.coalesce(F.when(text.rlike(pattern), spans), F.array()).cast(_SPANS)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``base`` and ``spans`` (arrays of start, rank, kind, end, in order) of every row, beside the columns ``keep``.

    ``base``: assignments, access keys and hex strings.  ``spans``: these and the candidates that the entropy
    test calls secret, if no base span covers them.  Null and empty texts have none.
    """
    kept = [c.alias(f"_keep{k}") for k, c in enumerate(keep or [])]
    df = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    long_enough = lambda h, k: F.length(F.regexp_extract(h, PATTERNS["assign"], 2)) >= LEAST_VALUE
    base = [_found(text, kind, rank, pattern, long_enough if kind == "assign" else lambda h, k: F.lit(True))
            for rank, (kind, pattern) in enumerate(PATTERNS.items())]
    more = _found(text, "entropy", len(PATTERNS), CANDIDATE, lambda h, k: _suspicious(h))
    names = [f"_keep{k}" for k in range(len(kept))]
    df = df.select(*names, "_text", F.array_sort(F.concat(*base)).alias("base"), more.alias("_more"))
    new = F.filter("_more", lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])))
    return df.select(*names, "_text", "base", F.array_sort(F.concat("base", new)).alias("spans"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the number of base spans per kind, the digest of the base spans and all spans as text.

    One pass over the rows without a shuffle.  Null and empty texts have no span; ids may be null or repeat; an
    empty table gives an empty result; other columns are not read.
    """
    found = scan(docs, text_col, [F.col(id_col)])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("_keep0").alias(id_col), *map(count, PATTERNS),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``, and ``size_col`` brought up to date.

    Rows without a span, null texts included, stay as they are.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text_col).alias("_body"))
    found = scan(whole, "_body", [F.col("_doc")])
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def merge(acc: Column, s: Column) -> Column:
        top = F.get(acc, F.size(acc) - 1)
        apart = F.coalesce(s["start"] >= top["end"], F.lit(True))
        one = F.struct(F.when(apart, s["start"]).otherwise(top["start"]).alias("start"),
                       F.when(apart, s["end"]).otherwise(F.greatest(s["end"], top["end"])).alias("end"))
        return F.concat(F.when(apart, acc).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))), F.array(one))

    def cut(a: Column, b: Column) -> Column:
        return F.substring("_text", (a + 1).cast("int"), (b - a).cast("int"))

    def replaced(merged: Column) -> Column:
        parts = F.transform(merged, lambda s, k: F.concat(
            cut(F.coalesce(F.get(merged, k - 1)["end"], F.lit(0)), s["start"]), F.lit(mark)))
        return F.concat(F.array_join(parts, ""), cut(F.get(merged, F.size(merged) - 1)["end"], F.length("_text")))

    found = found.withColumn("_clean", F.when(F.size("spans") > 0, let(F.aggregate("spans", none, merge), replaced)))
    columns = []
    for c in docs.columns:
        old = F.col("_keep0").getField(c)
        if c == text_col:
            old = F.coalesce(F.col("_clean"), old)
        elif c == size_col:
            old = F.when(F.col("_clean").isNotNull(), F.length("_clean").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return found.select(*columns)
