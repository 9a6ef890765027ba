"""WARC archives: writing and reading them, and the merged index of their captures.

Pages are written as WARC/1.1 records by Spark's own text writer: a record's end is the line separator, so
archives go to any file system Spark writes to, compressed as a whole, and partial files of lost executors never appear. Each archive is sorted
by URL key and time: it is one run of captures. The index reads the runs back and merges them, k at a time, with a loser
tree, into capture histories that are ordered over all partitions.

Scale: (digest, page_id) is pre-aggregated to find the first record of equal payloads; rows then move once, to their digest.
Archives are read as streams, so a reader holds a record and not a file, however large that is.
The merge is range-partitioned by URL key, time and page into ranges of about RANGE_ROWS captures, so that those of one hot URL
are many partitions; a task holds its own slice of the index, never payloads.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Payloads of fewer bytes are never replaced by a revisit record.
REVISIT_BYTES = 100
#: Records of one archive at most.
RECORDS = 1_000
#: Captures that a task merges, about.
RANGE_ROWS = 100_000
#: Without a time of its own a capture has one within so many seconds (a century) of the epoch: a year of four digits.
SPAN = 36_525 * 86_400
END = b"\r\n\r\n"
_INDEX = "run string, at long, url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: Column) -> Column:
    """A key that sorts a site's captures together: the host's parts from the last on, then the path; no scheme, www., port 80/443 or fragment. Null: empty."""
    clean = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(clean, "^([^/?]*)", 1), "^www[0-9]*\\.|:(80|443)$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.regexp_extract(clean, "^[^/?]*(.*)$", 1))


def _one_line(value: Column) -> Column:
    """A header's value: without spaces and tabs at its ends, which readers take away, and with line ends escaped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "\r", "%0D"), "\n", "%0A"), r"^[ \t]+|[ \t]+$", "")


def _seconds(moment: str) -> int:
    """Seconds of a moment in UTC since 1970."""
    return int(datetime.fromisoformat(moment).replace(tzinfo=timezone.utc).timestamp())


def _utc(seconds: Column) -> Column:
    """A second as text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_warc(pages: DataFrame, path: str, *, epoch: str = "2024-01-01 00:00:00", records: int = RECORDS) -> None:
    """Writes a record for each row of `pages` (page_id, url, html; optionally captured_at, a timestamp).

    Payload: html in UTF-8, a null as an empty one. Of records with equal payloads of at least REVISIT_BYTES bytes that
    with the smallest page_id is a response and the others are revisits without a payload; smaller ones are
    all responses. Rows that repeat that smallest page_id are responses as well, and so is a null page_id without
    an equal payload elsewhere. Without captured_at a capture's time is page_id seconds after `epoch` (UTC), modulo SPAN, so that
    any long gives a year of four digits and times sort as text; a captured_at after 9999 counts as its end, a null one as the epoch. Other
    columns are left out.
    """
    ids, start = F.col("page_id").cast("long"), F.lit(_seconds(epoch))
    when = start + F.pmod(F.coalesce(ids, F.lit(0)), F.lit(SPAN))
    if "captured_at" in pages.columns:
        when = F.least(F.greatest(F.coalesce(F.unix_timestamp("captured_at"), start), F.lit(_seconds("0001-01-01 00:00:00"))), F.lit(_seconds("9999-12-31 23:59:59")))
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(ids.alias("page_id"), _one_line(F.col("url")).alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("n"), F.sha2(body.cast("binary"), 256).alias("digest"), _utc(when).alias("captured"))
    firsts = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 and first_id is not null")
    # Only digests that repeat are joined; the hot ones are split by Spark's skew join.
    rows = rows.join(firsts.select("digest", "first_id"), "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.col("captured")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first_id")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    run = rows.withColumn("key", url_key(F.col("url"))).sortWithinPartitions("key", "captured", "page_id")
    run.select(F.concat(head, F.lit("\r\n\r\n"), block).alias("value")).write.options(lineSep=END.decode(), maxRecordsPerFile=records, compression="gzip").text(path)


def records(parts: Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers in lower case, block) of each record of an archive that comes in parts of any size; a torn one is an error.

    A lone END after the last record is none: who cuts an archive at its ENDs can't tell whether the last piece had one of its own.
    """
    held, base = bytearray(), 0  # bytes not yet given out, and the place of the first of them
    wanted, block, headers = 0, 0, {}
    for part in itertools.chain(parts, (None,)):
        if part is not None:
            held += part
            if len(held) < wanted:
                continue
        at = 0
        while at < len(held):
            if not wanted:
                cut = held.find(END, at)
                if cut < 0:
                    break
                if cut == at and cut + 4 == len(held):
                    break
                if not held.startswith(b"WARC/", at):
                    raise ValueError(f"no WARC record at byte {base + at}")
                lines = held[at:cut].decode("utf-8", "replace").split("\r\n")
                headers = {k.strip().lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in lines[1:])}
                block = cut + 4 - at
                wanted = block + int(headers["content-length"]) + 4
            if len(held) - at < wanted:
                break
            end = at + wanted - 4
            if held[end : end + 4] != END:
                raise ValueError(f"the record at byte {base + at} is torn")
            yield base + at, headers, bytes(held[at + block : end])
            at, wanted = end + 4, 0
        del held[:at]
        base += at
    if held and held != END:
        raise ValueError(f"the record at byte {base} is torn")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, piece): the pieces between ENDs of one archive after another, in order."""
    names = [c.split()[0] for c in _INDEX.split(", ")]

    def page(name: str | None) -> int | None:
        digits = name[len("<urn:x-page:") : -1] if name else ""
        return int(digits) if digits else None

    def pieces() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            kind = pa.large_binary() if pa.types.is_large_string(batch.column("value").type) else pa.binary()
            for path, piece in zip(batch.column("path"), batch.column("value").cast(kind), strict=True):
                yield path.as_py(), piece.as_py() + END

    for path, own in itertools.groupby(pieces(), key=lambda x: x[0]):
        rows = []
        for at, h, block in records(piece for _, piece in own):
            head, _, payload = block.partition(END)
            digest = h["warc-payload-digest"].removeprefix("sha256:")
            if h["warc-type"] == "response":
                size, hashed = len(payload), hashlib.sha256(payload).hexdigest()
                if hashed != digest:
                    raise ValueError(f"{path}: the payload at byte {at} is not the one that was written")
            else:
                size = next(int(line.partition(b":")[2]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
            rows.append((path, at, None, h["warc-date"], page(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], size, digest, page(h.get("warc-refers-to"))))
        if rows:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_warc(spark, path: str) -> DataFrame:  # noqa: ANN001
    """A row for each record of the archives under a path: run (its archive), at (byte of the archive as it is before compression), url_key, captured, page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    Archives are gzipped (whole, or a member for each record), so a file is one task's, which reads it as a stream. Payloads of
    responses are hashed again and held against their header.
    """
    files = spark.read.option("lineSep", END.decode()).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInArrow(_parsed, _INDEX).withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """Merges k sorted iterators: the losers of each match are kept, so the next smallest costs log2 k comparisons."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.heads: list[tuple | None] = [next(r, None) for r in runs]
        k = max(1, len(runs))
        self.losers = [0] * k
        winners = [0] * k + list(range(len(runs)))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            won, lost = (a, b) if self.before(a, b) else (b, a)
            winners[node], self.losers[node] = won, lost
        self.winner = winners[1] if len(winners) > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and (head := self.heads[self.winner]) is not None:
            yield head
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            node = (w + k) // 2
            while node:
                if self.before(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    run, key, when, page = (table.column(c).to_pylist() for c in ("run", "url_key", "captured", "page_id"))
    starts = [i for i in range(len(run)) if not i or run[i] != run[i - 1]]
    ranks = [(k, w, p is not None, p or 0) for k, w, p in zip(key, when, page, strict=True)]
    if fall := next((i for i in range(1, len(run)) if run[i] == run[i - 1] and ranks[i] < ranks[i - 1]), None):
        raise ValueError(f"{run[fall]} is no sorted run: {ranks[fall]} comes after {ranks[fall - 1]}")
    slices = [iter([(*ranks[i], i) for i in range(a, b)]) for a, b in zip(starts, [*starts[1:], len(run)], strict=True)]
    order = [x[-1] for x in LoserTree(slices)]
    yield from table.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=10_000)


def merged_index(records_of_runs: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """The captures of all runs in the order of url_key, captured, page_id: within a partition, and from one to the next.

    Ranges hold whole captures of each run's slice in the run's order; those slices are merged by a loser tree.
    """
    n = partitions or max(int(records_of_runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-records_of_runs.count() // RANGE_ROWS))
    ranges = records_of_runs.repartitionByRange(n, "url_key", "captured", "page_id").sortWithinPartitions("run", "at")
    return ranges.mapInArrow(_merged, records_of_runs.schema)
