"""WARC archives with a merged external index.

``write_archives`` writes a record per page: ``response`` for the smallest page_id of equal payloads,
``revisit`` for the others.  Files are gzipped UTF-8 WARC/1.1 in the shared folder, at most ``file_records`` records and about
``ARCHIVE_BYTES`` each (a longer record has a file of its own), since a reader holds one file at a time.  The html of a page
that is a revisit already by a copy before it in its task isn't shuffled.
``read_archives`` parses them by Content-Length.  ``capture_history`` is the external merge: each file gives
a run sorted by URL key and timestamp; runs are cut by sampled URL keys, and a loser tree merges the pieces of
a cut k ways into globally ordered captures.

Defined results: null html is an empty payload; a null url is empty; null page ids are written as ``null`` and
read as null; payloads under ``least`` bytes are always responses; pages with equal payload and equal smallest
id (repeated rows) are all responses; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import shared_folder, written

RECORD = "page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string, file string, record long"
#: Bytes of records, before gzip, from which on a task goes on with its next archive.
ARCHIVE_BYTES = 32 << 20
#: Payload digests a task remembers at a time to drop copies early; with more it starts anew, and the join drops them.
MOST_DIGESTS = 1 << 18
CAPTURE = "url_key string, captured string, page_id long, payload_digest string, record_type string, file string, record long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [(x or "").encode() for x in batch["html"].to_pylist()]
        found = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array([p.decode() for p in payloads], pa.string()), pa.array(map(len, payloads), pa.int64()), pa.array(found, pa.string())], ["page_id", "url", "html", "payload_bytes", "payload_digest"])


def _without_copies(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Like ``_digests``; null html where an equal payload of a smaller page id went before: that page can only be a revisit."""
    smallest: dict[str, int] = {}
    for batch in _digests(batches):
        copies = []
        for page, size, digest in zip(*(batch[n].to_pylist() for n in ("page_id", "payload_bytes", "payload_digest")), strict=True):
            seen = smallest.get(digest)
            copies.append(size >= least and seen is not None and (page is None or page > seen))
            if page is not None and (seen is None or page < seen):
                if len(smallest) >= MOST_DIGESTS:
                    smallest.clear()
                smallest[digest] = page
        html = pc.if_else(pa.array(copies, pa.bool_()), pa.scalar(None, pa.string()), batch["html"])
        yield pa.RecordBatch.from_arrays([html if n == "html" else batch[n] for n in batch.schema.names], batch.schema.names)


def _records(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """A record as text without its last line feed, which the text sink adds, and the number of its archive in the task."""
    archive = held = 0
    for batch in batches:
        out, archives = [], []
        for row in batch.to_pylist():
            body = "" if row["refers_to"] is not None else row["html"]
            url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
            page = "null" if row["page_id"] is None else row["page_id"]
            head = [
                "WARC/1.1",
                f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}",
                f"WARC-Record-ID: <urn:page:{page}>",
                f"WARC-Date: {row['captured']}",
                f"WARC-Target-URI: {url}",
                f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
                f"X-Payload-Length: {row['payload_bytes']}",
            ]
            if row["refers_to"] is not None:
                head += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            head += ["Content-Type: text/html", f"Content-Length: {len(body.encode())}"]
            out.append("\r\n".join(head) + "\r\n\r\n" + body + "\r\n\r")
            size = len(out[-1].encode())
            if held and held + size > archive_bytes:
                archive, held = archive + 1, 0
            held += size
            archives.append(archive)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(archives, pa.int32())], ["value", "archive"])


def write_archives(pages: DataFrame, least: int = 0, file_records: int = 4_000, captured: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes the archives and returns their folder.  ``captured`` names a column with the WARC date (else a date derived from the page id)."""
    spark = pages.sparkSession
    when = F.col(captured).cast("string") if captured else F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce(F.pmod("page_id", F.lit(100_000_000)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    columns = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), *([captured] if captured else []))
    dated = columns.withColumn("captured", when).select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "captured")
    # the digest alone is needed to find first copies: payloads aren't shuffled for it
    brief = dated.select("page_id", "url", "html").mapInArrow(_digests, "page_id long, url string, html string, payload_bytes long, payload_digest string")
    firsts = brief.select("page_id", "payload_bytes", "payload_digest").where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("payload_digest", "first_id")
    full = dated.select(F.to_json(F.struct("url", "captured")).alias("url"), "page_id", "html").select("page_id", "url", "html").mapInArrow(lambda b: _without_copies(b, least), "page_id long, url string, html string, payload_bytes long, payload_digest string")
    full = full.withColumn("meta", F.from_json("url", "url string, captured string")).select("page_id", F.col("meta.url").alias("url"), F.col("meta.captured").alias("captured"), "html", "payload_bytes", "payload_digest")
    joined = full.join(firsts, "payload_digest", "left")
    typed = joined.withColumn("refers_to", F.when((F.col("payload_bytes") >= least) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id"))), F.col("first_id")))
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = typed.select("page_id", "url", "captured", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise("").alias("html"), "payload_bytes", "payload_digest", "refers_to")
    records = rows.mapInArrow(lambda b: _records(b, archive_bytes), "value string, archive int")
    records.write.partitionBy("archive").option("maxRecordsPerFile", file_records).text(folder, compression="gzip", lineSep="\n")
    return folder


def parse_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower-case names) and bodies of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda urn: None if urn is None or urn[10:-1] == "null" else int(urn[10:-1])
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in RECORD.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for i in range(batch.num_rows):
            rows, held = [], 0
            for k, (head, body) in enumerate(parse_records(gzip.decompress(batch["content"][i].as_py()))):
                whole = head["warc-type"] == "response"
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else head["warc-payload-digest"].partition(":")[2]
                size = len(body) if whole else int(head["x-payload-length"])
                rows.append((number(head["warc-record-id"]), head["warc-target-uri"], head["warc-date"], size, digest, head["warc-type"], number(head.get("warc-refers-to")), body.decode(), batch["path"][i].as_py(), k))
                held += len(body)
                if held > 8 << 20:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of all archives in the folder; sizes and digests of responses come from the bytes read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(_parsed, RECORD)


class LoserTree:
    """Merges k sorted iterators; each step replays one path of losers, log2 k comparisons."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._less(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        if not self.k:
            return
        while (head := self.heads[winner := self.losers[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def url_key(url: str) -> str:
    """Host labels reversed, then port, path and query: captures of a site are neighbours."""
    rest = url.split("://", 1)[-1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, _, port = rest[:cut].lower().partition(":")
    return ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port else "") + ")" + rest[cut:].partition("#")[0]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([url_key(u or "") for u in batch["url"].to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([keys, *(batch[n] for n in ("captured", "page_id", "payload_digest", "record_type", "file", "record"))], [x.split()[0] for x in CAPTURE.split(", ")])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of a partition, which arrive run by run, each sorted; runs stay as Arrow columns."""
    pieces: dict[str, list[pa.RecordBatch]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        names = batch["file"].to_pylist()
        cut = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for i, j in zip(cut, cut[1:], strict=False):
            if j > i:
                pieces.setdefault(names[i], []).append(batch.slice(i, j - i))

    def rows(run: list[pa.RecordBatch]) -> Iterator[tuple]:
        for piece in run:
            for begin in range(0, piece.num_rows, 1024):
                part = piece.slice(begin, 1024).to_pydict()
                page = [-1 if x is None else x for x in part["page_id"]]
                yield from zip(part["url_key"], part["captured"], page, part["payload_digest"], part["record_type"], part["file"], part["record"], strict=True)

    out = []

    def table() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out, strict=True)]
        columns[2] = [None if x == -1 else x for x in columns[2]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    for row in LoserTree([rows(r) for r in pieces.values()]):
        out.append(row)
        if len(out) == 4096:
            yield table()
            out = []
    if out:
        yield table()


def capture_history(records: DataFrame, cuts: int | None = None) -> DataFrame:
    """All captures in global order: by URL key, timestamp, page id.  ``position`` counts from 0 over all partitions.

    The range partitioner samples (url_key, captured) for the cuts, so a URL with very many captures spreads by time.
    """
    spark = records.sparkSession
    keyed = records.select("url", "captured", "page_id", "payload_digest", "record_type", "file", "record").mapInArrow(_keyed, CAPTURE)
    n = cuts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = keyed.repartitionByRange(n, "url_key", "captured", "page_id").sortWithinPartitions("file", "url_key", "captured", "page_id", "payload_digest", "record_type", "record")
    merged = runs.mapInArrow(_merged, CAPTURE).withColumn("cut", F.spark_partition_id())
    merged = merged.withColumn("within", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    merged = written(merged, "captures")
    # one row per cut: the starts of all cuts, counted by as many rows as there are tasks
    from pyspark.sql import Window

    starts = merged.groupBy("cut").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1))).select("cut", F.coalesce("start", F.lit(0)).alias("start"))
    return merged.join(F.broadcast(starts), "cut").withColumn("position", F.col("start") + F.col("within")).drop("cut", "within", "start")
