"""Sources and sinks.

JSON arrays and JSON-lines logs come in through Spark's readers with an
explicit schema; stages exchange parquet.  No file is opened on the driver.
A value that does not fit its column becomes null and the raw line is kept in
``_corrupt_record``: a well-formed object is never dropped, and a line that is
more or less than one object never kept (Python's ``json`` tells, as the rule does).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloop.functions import text as tx

CORRUPT = "_corrupt_record"


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file holding one JSON array of objects.

    ``multiLine`` parses each file whole (one task per file): convert once to
    parquet and read that downstream.  A file that is no array raises ``ValueError``.
    """
    other = _heads(spark, path).filter("head <> '['").first()
    if other is not None:
        raise ValueError(f"{other['file']} does not hold a JSON array")
    r = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return schema if CORRUPT in schema.fieldNames() else T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])


def _object_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """The lines that are JSON objects, parsed; ``_raw_file`` and ``_raw_pos`` give file and order within it.

    Blank lines, arrays, scalars and lines that are not one whole object give no row; of repeated keys the last counts.
    """
    full = _with_corrupt(schema)
    lines = spark.read.text(paths).select(
        "value", F.input_file_name().alias("_raw_file"), F.monotonically_increasing_id().alias("_raw_pos"))
    whole = lines.withColumn("_json", tx.whole_object_json("value")).filter(F.col("_json").isNotNull())
    parsed = F.from_json("_json", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    line = F.when(F.col(f"_o.{CORRUPT}").isNotNull(), F.col("value")).alias(CORRUPT)
    return whole.withColumn("_o", parsed).select(
        *[line if c == CORRUPT else F.col(f"_o.`{c}`") for c in full.fieldNames()], "_raw_file", "_raw_pos")


def read_keyed_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str,
                     seq_col: str = "ingest_seq") -> DataFrame:
    """Tolerant JSON lines: blank, malformed and non-object lines and rows
    without a non-empty string key are skipped; all other rows stay, also those
    with a value of another type (null there, the line in ``_corrupt_record``).
    Adds ``seq_col`` (file, line order) so that J5 can keep the last line per key."""
    df = _object_lines(spark, path, schema).filter(F.col(key).isNotNull() & (F.col(key) != ""))
    return df.withColumn(seq_col, F.struct(F.col("_raw_file").alias("file"), F.col("_raw_pos").alias("pos"))).drop(
        "_raw_file", "_raw_pos")


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``head``: the first non-blank character of every file below ``path`` that has one."""
    lines = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos"), tx.py_lstrip("value").alias("line"))
    return lines.filter(F.col("line") != "").groupBy("file").agg(F.min_by(F.substring("line", 1, 1), "pos").alias("head"))


def array_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """S3 helper: the files below ``path`` whose first non-blank character is ``[``, and the others.

    A row per file reaches the driver, as the names of the files to read do.
    """
    heads = _heads(spark, path).collect()
    return [r["file"] for r in heads if r["head"] == "["], [r["file"] for r in heads if r["head"] != "["]


def read_json_or_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: array files and JSON lines, decided for every file on its own."""
    arrays, lines = array_files(spark, path)
    full = _with_corrupt(schema)
    out = spark.createDataFrame([], full)
    if arrays:
        rows = spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(arrays)
        out = out.unionByName(rows)
    if lines:
        out = out.unionByName(_object_lines(spark, lines, schema).drop("_raw_file", "_raw_pos"))
    return out


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> None:
    """Table sink (parquet by default; ``json`` writes JSON lines)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    getattr(w, fmt)(path)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append-only result log (idempotent keys make retries safe)."""
    write_table(df, path, mode="append", fmt=fmt)


def resolve_split(spark: SparkSession, root: str, requested: str | None = None,
                  preference: Sequence[str] = ("test", "validation", "train")) -> DataFrame:
    """A table stored as ``split=<name>/`` partitions: the requested split if
    present, else the first of the preference order, else the first split.
    Reading one split is partition pruning on ``split``."""
    df = spark.read.parquet(root)
    splits = [r.split for r in df.select("split").distinct().collect()]  # a handful of names
    order = ([requested] if requested else []) + list(preference) + sorted(splits)
    chosen = next(s for s in order if s in splits)
    return df.filter(F.col("split") == chosen)


def seed_or_empty(spark: SparkSession, path: str, schema: T.StructType, seed_path: str | None = None) -> DataFrame:
    """Existing table, else the seed, else an empty table of the schema."""
    from evalloop.session import path_exists

    for p in (path, seed_path):
        if p and path_exists(spark, p):
            return spark.read.schema(schema).parquet(p)
    return spark.createDataFrame([], schema)


def upsert_manifest(manifest: DataFrame | None, entries: DataFrame, key: str = "dataset_name",
                    seq: str = "version") -> DataFrame:
    """Dataset registry; the entry with the highest version wins per name."""
    allrows = entries if manifest is None else manifest.unionByName(entries, allowMissingColumns=True)
    others = [c for c in allrows.columns if c != key]
    best = allrows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_r"))
    return best.select(key, *[F.col("_r." + c).alias(c) for c in others])


def run_index(spark: SparkSession, run_name: str, entries: Sequence[tuple[str, int, str]]) -> DataFrame:
    """``(run_name, role, iter, path)`` rows describing one loop run."""
    schema = "run_name string, role string, iter int, path string"
    return spark.createDataFrame([(run_name, r, i, p) for r, i, p in entries], schema)
