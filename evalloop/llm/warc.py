"""WARC archives written and read by Spark, and one capture index merged from sorted runs.

Records are written by Spark's text writer, whose line separator is the two line ends that close a record: the
files reach any store Spark can write, and a lost executor's files are written anew.  Reading parses the
files by the lengths in the records' headers.  Each archive gives one run of index entries sorted by URL key
and time (and the place in the archive); the runs are stored, cut into ranges of the whole order, and a
loser tree merges the runs of each range, so that the ranges one after another are the capture histories.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloop.llm.common import cut_lineage, ensure_checkpoint_dir, prepare, runs_of, small_side

#: Payloads below this size are never revisits.
LEAST_BYTES = 100
#: Archives hold about so many bytes (or one larger record), which bounds what a reader holds.
ARCHIVE_BYTES = 64 << 20
#: Payloads up to each of these sizes share archives; larger ones have one each.
SIZE_CLASSES = (1 << 14, 1 << 18, 1 << 22)
#: Entries that a merging task holds, about.
MERGE_ROWS = 500_000
END = "\r\n\r\n"
#: Seconds through which the default capture times go.
TIMES = 1_000_000_000

ENTRY = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
         "url_key string, captured_at string, file string, offset bigint, length bigint")


def url_key(url: str) -> str:
    """The sort key of a URL: host names reversed, ``com,example)/path``, letters A-Z lower-cased in the host."""
    rest = url.split("://", 1)[-1]
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host = rest[:cut].rpartition("@")[2].lower()
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:].split("#", 1)[0] or "/")


def capture_time(id_: Column) -> Column:
    """A time in UTC that counts seconds from the id, round and round through ``TIMES``, whatever the session's time zone."""
    seconds = F.pmod(F.coalesce(id_.cast("long"), F.lit(0)), F.lit(TIMES))
    time = F.lit("2023-11-14 22:13:20").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.concat(F.replace(time.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def _shared(rows: DataFrame) -> DataFrame:
    """``of``, ``first``: digests that several payloads of ``LEAST_BYTES`` or more share, with their smallest id."""
    big = rows.filter(F.col("bytes") >= LEAST_BYTES).select("digest", "page_id")
    shared = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return small_side(cut_lineage(shared.select(F.col("digest").alias("of"), "first"), "warc-shared"))


def _record() -> Column:
    """The text of a record without its end: headers, an empty line, the payload (revisits have none)."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.coalesce(F.concat(F.lit(key + ": "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.col("captured_at")),
        line("WARC-Target-URI", address),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(revisit, name(F.col("refers_to")))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("html")))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
          date: Column | None = None) -> None:
    """Writes a record per row below ``path``; ``date``: the capture time in ISO form, by default counted from the id.

    Digests come first, from a narrow pass; only digests that several payloads share are joined back.  A null
    body is an empty payload, a null url leaves out its header.
    """
    html = F.coalesce(F.col(body_col), F.lit(""))
    when = date if date is not None else capture_time(F.col(id_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), when.alias("captured_at"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    shared = _shared(rows)
    revisit = (F.col("bytes") >= LEAST_BYTES) & F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    tagged = rows.join(shared, F.col("digest") == F.col("of"), "left").withColumn("refers_to", F.when(revisit, F.col("first")))
    used = {r["k"] for r in rows.groupBy(_size_class().alias("k")).count().collect()} or {0}  # a row per class at most
    for k in sorted(used):
        # the records of a class are no larger than its limit, so their number bounds the archive
        limit = ARCHIVE_BYTES // SIZE_CLASSES[k] if k < len(SIZE_CLASSES) else 1
        tagged.filter(_size_class() == k).select(_record().alias("value")).write.option("lineSep", END).option(
            "maxRecordsPerFile", limit).mode("errorifexists").text(f"{path.rstrip('/')}/size-{k}")


def _size_class() -> Column:
    return F.size(F.filter(F.array(*map(F.lit, SIZE_CLASSES)), lambda limit: F.col("bytes") > limit))


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers (lower-case names), payload, offset and length of each record of an archive."""
    at = 0
    while at < len(data):
        body = data.index(END.encode(), at) + len(END)
        lines = data[at:body].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}: {lines[0][:40]!r}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}
        end = body + int(head["content-length"])
        if data[end:end + len(END)] != END.encode():
            raise ValueError(f"the record at {at} is cut off")
        yield head, data[body:end], at, end + len(END) - at
        at = end + len(END)


def _id(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _entry(head: dict[str, str], payload: bytes, file: str, at: int, size: int) -> tuple:
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    kind = head["warc-type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload at {at} of {file} does not have the digest of its header")
    refers = _id(head["warc-refers-to"]) if "warc-refers-to" in head else None
    size_of = len(payload) if kind == "response" else int(head["x-payload-length"])
    return (_id(head["warc-record-id"]), size_of, digest, kind, refers, url_key(head.get("warc-target-uri", "")),
            head["warc-date"], file, at, size)


def order(entry: Sequence) -> tuple:
    """The order of capture histories: URL key, time, then the place of the record."""
    return entry[5], entry[6], entry[7], entry[8]


_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string()),
                     ("captured_at", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _batch(entries: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*entries))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def sorted_runs(spark, path: str) -> DataFrame:
    """The index entries of all archives below ``path``: each archive is parsed in its task and sorted as one run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                name = "/".join(file.as_py().rsplit("/", 2)[1:])
                entries = sorted((_entry(h, p, name, at, size) for h, p, at, size in records(data.as_py())), key=order)
                for k in range(0, len(entries), 4096):
                    yield _batch(entries[k:k + 4096])

    return files.mapInArrow(run, ENTRY)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a step replays one path of log2 k matches."""

    def __init__(self, runs: Sequence[Iterator], key):
        self.runs, self.key, self.k = list(runs), key, len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._play(1) if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        """Run ``a`` comes before run ``b``; a run that has ended comes last, and equal keys keep the runs' order."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None or (self.keys[b] is None and a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        return winner

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merge(runs: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """``runs`` (a stored table of entries) in one order: ``part`` and ``position`` within it are added.

    Ranges are cut by URL key, time and place, so the captures of one URL that has a third of all rows spread over
    many; a range holds about ``merge_rows`` narrow entries.  Within a range, Spark's sort brings each run
    together in order (spilling if it must) and the loser tree merges the runs.
    """
    spark = runs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, runs.count() // merge_rows + 1)
    keys = ["url_key", "captured_at", "file", "offset"]
    numbered = runs.withColumn("_run", F.xxhash64("file"))
    ranged = numbered.repartitionByRange(parts, *keys).sortWithinPartitions("_run", *keys)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        slices = [rows.drop_columns(["_run"]) for rows in runs_of(batches, ["_run"])]

        def entries(rows: pa.Table):
            for batch in rows.to_batches():
                yield from zip(*[c.to_pylist() for c in batch.columns])

        held, position = [], 0
        for entry in LoserTree([entries(s) for s in slices], order):
            held.append(entry)
            if len(held) == 4096:
                yield _placed(held, part, position)
                position, held = position + len(held), []
        if held:
            yield _placed(held, part, position)

    return ranged.mapInArrow(run, ENTRY + ", part int, position bigint")


def _placed(entries: list[tuple], part: int, position: int) -> pa.RecordBatch:
    batch = _batch(entries)
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array([part] * len(entries), pa.int32()), pa.array(range(position, position + len(entries)), pa.int64())],
        names=[*batch.schema.names, "part", "position"])


def histories(spark, path: str) -> DataFrame:
    """The capture histories of all archives below ``path``, in order of ``part`` and ``position``."""
    prepare(spark)
    return merge(cut_lineage(sorted_runs(spark, path), "warc-runs"))


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes ``pages`` as WARC archives and reads them back as capture histories.

    ``path``: where the archives go, by default a new folder in the shared checkpoint folder.  Rows with equal
    payloads of at least ``LEAST_BYTES`` refer to the smallest id; null ids come back null, rows that repeat an id
    each have a record; an empty table gives no record; other columns are not read.
    """
    spark = pages.sparkSession
    prepare(spark)
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    write(pages, path, id_col, url_col, body_col)
    return histories(spark, path)
