r"""WARC archives: written with Spark's text writer, read back with boundary-chain verification.

Writing: a record's text ends in the writer's line separator, which is the blank line pair that ends WARC records, so
files are plain WARC and go through Spark's commit. Files are cut by running bytes. Of records with the same payload, all but one become revisits.

Reading: files are looked at in parts. A task emits each place of its part that looks like a record's header, with the
place where that record says it ends, followed as far as the part goes. Pointer jumping from each file's start then
finds the places where a real chain enters each part; it doubles its steps every round. What looks like a header inside
a payload is on no chain and goes. At last each part's chain, a contiguous range of bytes, is parsed into records. Headers
that end beyond what a part looks at are resolved from the whole file, in a second pass over the files that have some.

Defined results: a null payload is empty; a null URL has no target header; an id that repeats with the kept payload is
a response each time; an empty table writes no record and reads back none; a record cut off at the end of its file is
dropped, and a chain ends where no record begins; other columns are ignored. A URL or payload of any length is kept
whole; a record longer than FILE has a file of its own. A file is read as one row, so archives from elsewhere may have
files of up to 2 GB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, materialize, small_side

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1_000
#: Bytes of a file, about, and of a part, and how far a part looks for the end of a header; longer headers take a second pass.
FILE, PART, HEADER = 32 << 20, 4 << 20, 64 << 10
#: Up to so many groups of equal payloads, or entries into parts, are broadcast.
BROADCAST_ROWS = 200_000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]+)[ \t]*\r\n", re.IGNORECASE)


def with_revisits(pages: DataFrame, *, row_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``page_id, url, payload, bytes, digest, keeper``: ``keeper`` is the id of the response of an equal payload that is stored once, else null."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(row_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("bytes"), F.sha1(body.cast("binary")).alias("digest"))
    groups = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(small_side(materialize(groups, "groups"), BROADCAST_ROWS), ["digest", "bytes"], "left")


def record_text(rows: DataFrame) -> DataFrame:
    """One column: each record without its closing blank lines."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    target = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("keeper")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), target)).otherwise(F.lit("")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("_block").cast("string"), F.lit(END),
    )
    return rows.withColumn("_block", block).select(F.concat(header, F.col("_block")).alias("value"))


def _in_files(most: int):
    """Numbers the files of a task: a file has up to ``most`` bytes, or one record."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = filled = 0
        for batch in batches:
            files = []
            for size in pc.binary_length(batch.column(0)).to_pylist():
                if filled and filled + size + len(END) > most:
                    file, filled = file + 1, 0
                files.append(file)
                filled += size + len(END)
            yield pa.record_batch([batch.column(0), pa.array(files, pa.int32())], names=["value", "file"])

    return task


def write_warc(pages: DataFrame, path: str, **columns: str) -> None:
    """Writes one record for each row of ``pages`` below ``path``; a file has up to FILE bytes, or one record that is longer."""
    texts = in_arrow(record_text(with_revisits(pages, **columns)), _in_files(FILE), "value string, file int")
    texts.write.partitionBy("file").option("lineSep", END).text(path)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[str, int, int | None]] = []
        for path, base, data in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), batch.column("data")):
            piece = data.as_py()
            ends: dict[int, int] = {}
            beyond: list[int] = []
            for m in _MAGIC.finditer(piece, 0, min(len(piece), PART + 10)):
                if m.start() >= PART:
                    break
                stop = piece.find(b"\r\n\r\n", m.end() - 2, m.end() + HEADER)
                length = _LENGTH.search(piece, m.end() - 2, stop + 2) if stop >= 0 else None
                if length:
                    ends[m.start()] = stop + 4 + int(length[1]) + 4
                elif stop < 0:
                    beyond.append(m.start())
            exits: dict[int, int] = {}
            for start in sorted(ends, reverse=True):  # a successor that is a candidate of this part hands on its own exit
                exits[start] = exits.get(ends[start], ends[start])
            out += [(path, base + s, base + e) for s, e in exits.items()] + [(path, base + s, None) for s in beyond]
        yield _exits(out)


def _exits(rows: list[tuple[str, int, int | None]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["path", "start", "exit"])


def _long_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of whole files whose header ends more than HEADER bytes on, in one walk over each file."""
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            piece, stop, length, out = data.as_py(), -1, None, []
            for m in _MAGIC.finditer(piece):
                low = m.end() - 2
                if stop < low and (stop := piece.find(b"\r\n\r\n", low)) < 0:
                    break
                if stop + 4 <= m.end() + HEADER:  # its part has it
                    continue
                if (length is None or length.start() < low) and (length := _LENGTH.search(piece, low)) is None:
                    break
                if length.end() <= stop + 2:
                    out.append((path, m.start(), stop + 4 + int(length[1]) + 4))
            yield _exits(out)


def chain_entries(candidates: DataFrame) -> DataFrame:
    """``path, start, exit`` of the candidates that pointer jumping from each file's start reaches."""
    jumps = materialize(candidates, "jumps")
    reached = materialize(jumps.where("start = 0").select("path", "start"), "reached")
    entries, count = jumps, reached.count()
    while count:
        ahead = reached.join(jumps, ["path", "start"]).select("path", F.col("exit").alias("start"))
        more = materialize(reached.union(ahead.join(entries.select("path", "start"), ["path", "start"], "left_semi")).distinct(), "reached")
        new = more.count()
        reached = more
        if new == count:
            break
        count = new
        after = jumps.select("path", F.col("start").alias("exit"), F.col("exit").alias("end"))
        jumps = materialize(jumps.join(after, ["path", "exit"]).select("path", "start", F.col("end").alias("exit")), "jumps")
    return entries.join(reached, ["path", "start"], "left_semi")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "refers_to", "target", "digest", "payload_length", "payload"]
    for batch in batches:
        for data in batch.column("data"):
            piece, at, rows = data.as_py(), 0, []
            while m := _MAGIC.match(piece, at):
                stop = piece.find(b"\r\n\r\n", m.end() - 2)
                fields = {}
                for line in piece[m.end() : stop].split(b"\r\n"):
                    key, _, value = line.partition(b":")
                    fields[key.strip().lower()] = value.strip()
                body, end = stop + 4, stop + 4 + int(fields[b"content-length"])
                if end > len(piece):
                    break
                head = piece.find(b"\r\n\r\n", body, end) if fields.get(b"content-type", b"").startswith(b"application/http") else body - 4
                text = lambda key: v.decode("utf-8", "replace") if (v := fields.get(key)) is not None else None  # noqa: B023, E731
                rows.append((text(b"warc-record-id"), text(b"warc-type"), text(b"warc-refers-to"), text(b"warc-target-uri"), text(b"warc-payload-digest"), int(fields.get(b"x-payload-length", -1)), piece[head + 4 : end]))
                at = end + 4
            kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, record_type, refers_to, target, digest, payload_length, payload`` of all records on the chains of the files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).where("length > 0")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(PART).cast("long")))
    parts = files.select("path", "content", part.alias("base")).select("path", "base", F.substring("content", F.col("base").cast("int") + 1, F.lit(PART + HEADER + 16)).alias("data"))
    found = materialize(parts.mapInArrow(_candidates, "path string, start long, exit long"), "candidates")
    candidates, beyond = found.where("exit IS NOT NULL"), found.where("exit IS NULL").select("path").distinct()
    if not beyond.isEmpty():
        whole = files.select("path", "content").join(small_side(beyond, BROADCAST_ROWS), "path")
        candidates = candidates.union(whole.mapInArrow(_long_headers, "path string, start long, exit long"))
    entries = materialize(chain_entries(candidates), "entries")
    chains = files.select("path", "content").join(small_side(entries, BROADCAST_ROWS), "path")
    chains = chains.select(F.substring("content", F.col("start").cast("int") + 1, (F.col("exit") - F.col("start")).cast("int")).alias("data"))
    return chains.mapInArrow(_parse, "record_id string, record_type string, refers_to string, target string, digest string, payload_length long, payload binary")
