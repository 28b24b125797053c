"""Writing pages as WARC/1.1 archives and reading them back through a chunked record table (operator 2).

A payload is cut into chunks of bounded size: rows of (record_id, chunk_no, chunk), made by the JVM
without copying the whole. A streaming pass over these rows keeps one running SHA-256 for the record
it is in and turns every chunk into one WARC record: the first a ``response`` or ``revisit``, later ones
``continuation`` segments as the standard defines for oversized records, each with its block's digest
and, on the last, the whole length and digest. Readers work the same way: a state machine over lines
that holds one line, never a record.

The archives are ordinary ``.warc.gz`` text of the file sink (one gzip stream a file, which no reader
splits), committed by Spark's protocol, so a lost executor or a repeated task leaves no partial archive.

Of records with equal payloads of at least ``least`` bytes, that with the smallest id is the response and
the others are revisits of it, without a payload. Which digests repeat is found from digests alone; payloads are
not shuffled while at most ``SENT_DIGESTS`` of them repeat, as that table then goes to every task.

Defined results: a null or empty payload is a response of 0 bytes; a null target URI is left out; line
ends and any bytes inside a payload are kept; equal rows give one record each, and rows that share the smallest id of equal
payloads are all responses; a null id is written and read back as null (it sorts last among equal payloads);
an empty table gives no records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.hashing import bound_batches, lean
from corpuslens.plans.lineage import table_path, written

CHUNK = 1 << 18
#: Repeated digests (32 bytes and an id each) up to which they are sent to every task.
SENT_DIGESTS = 1 << 17
_RECORD = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, segments int, complete boolean"


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """Rows of (record_id, url, payload, digest, refers_to): refers_to is set for revisits only."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("record_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= least).select("record_id", F.unhex("digest").alias("same")).groupBy("same").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(first.where("n > 1 AND first IS NOT NULL").drop("n"), "repeated")
    if first.count() <= SENT_DIGESTS:
        first = F.broadcast(first)
    joined = rows.join(first, F.unhex("digest") == F.col("same"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first"))
    return joined.select("record_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def chunk_table(records: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(record_id, url, refers_to, digest, length, chunk_no, last, chunk): chunks of a record follow each other; a revisit has one, empty."""
    length = F.octet_length("payload").cast("long")
    count = F.when(F.col("refers_to").isNotNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(length / F.lit(chunk)))).cast("int")
    exploded = records.withColumns({"length": length, "n": count}).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk_no") * F.lit(chunk) + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return exploded.select("record_id", "url", "refers_to", "digest", "length", "chunk_no", (F.col("chunk_no") == F.col("n") - 1).alias("last"), part.alias("chunk"))


def _name(record_id: object) -> str:
    """A record's id in its name: empty for null, else marked and percent-encoded."""
    return "" if record_id is None else f"~{quote(str(record_id), safe='')}"


def _id(name: str | None) -> str | None:
    found = "" if name is None else name.removeprefix("<urn:record:").rpartition(":")[0]
    return unquote(found[1:]) if found else None


def _segment(row: dict, whole: str, block: str) -> bytes:
    first, data = row["chunk_no"] == 0, row["chunk"]
    revisit = row["refers_to"] is not None
    name = _name(row["record_id"])
    lines = ["WARC/1.1", f"WARC-Type: {('revisit' if revisit else 'response') if first else 'continuation'}", f"WARC-Record-ID: <urn:record:{name}:{row['chunk_no']}>"]
    if row["url"] is not None and first:
        lines.append(f"WARC-Target-URI: {' '.join(row['url'].split())}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:record:{_name(row['refers_to'])}:0>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    if not (first and row["last"]):
        lines += [f"WARC-Segment-Number: {row['chunk_no'] + 1}", f"WARC-Segment-Origin-ID: <urn:record:{name}:0>"]
    lines.append(f"WARC-Block-Digest: sha256:{block}")
    if row["last"]:
        lines += [f"WARC-Payload-Digest: sha256:{whole}", f"WARC-Segment-Total-Length: {row['length']}"]
    lines.append(f"Content-Length: {len(data)}")
    # the sink ends each row with the last \n of the record's two line ends
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + data + b"\r\n\r"


def write_archives(chunks: DataFrame, path: str) -> None:
    """Write the chunk table as ``.warc.gz`` files under ``path``; one streaming pass, no shuffle."""

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        running, of = hashlib.sha256(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    running, of = hashlib.sha256(), row["record_id"]
                assert of == row["record_id"], "chunks of a record are apart"
                running.update(row["chunk"])
                whole = row["digest"] if row["refers_to"] is not None else running.hexdigest()
                out.append(_segment(row, whole, hashlib.sha256(row["chunk"]).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # the cast keeps the bytes as they are; the sink writes them and \n
    chunks.mapInArrow(serialise, "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


class _Reader:
    """The state machine over the lines of one archive: what it holds is a header and a running digest."""

    def __init__(self) -> None:
        self.header: dict[str, str] | None = None
        self.left, self.record, self.done = 0, None, []

    def line(self, data: bytes) -> None:
        if self.left > 0:  # inside a block; the line end that was taken off belongs to it while bytes are left
            block = data + b"\n"
            used = block[: self.left]
            self.left -= len(used)
            self.record["sha"].update(used)
            self.block.update(used)
            self.record["bytes"] += len(used)
            if self.left == 0:
                self._end()
        elif self.header is None:
            if data.rstrip(b"\r") == b"WARC/1.1":
                self.header = {}
        elif data.rstrip(b"\r"):
            name, _, value = data.rstrip(b"\r").decode("utf-8", "replace").partition(":")
            self.header[name.lower()] = value.strip()
        else:
            self._begin()

    def _begin(self) -> None:
        h = self.header
        if h["warc-type"] != "continuation":
            self._flush()
            self.record = {"h": h, "sha": hashlib.sha256(), "bytes": 0, "segments": 0, "ok": True}
        elif self.record is None or h["warc-segment-origin-id"] != self.record["h"]["warc-record-id"] or int(h["warc-segment-number"]) != self.record["segments"] + 1:
            raise ValueError(f"segment {h['warc-record-id']} does not follow its record")
        self.record["segments"] += 1
        self.block, self.left = hashlib.sha256(), int(h["content-length"])
        if self.left == 0:
            self._end()

    def _end(self) -> None:
        h, r = self.header, self.record
        r["ok"] &= h["warc-block-digest"] == f"sha256:{self.block.hexdigest()}"
        if "warc-segment-total-length" in h:
            r["length"], r["digest"] = int(h["warc-segment-total-length"]), h["warc-payload-digest"].removeprefix("sha256:")
        self.header = None

    def _flush(self) -> None:
        r, self.record = self.record, None
        if r is None:
            return
        h, kind = r["h"], r["h"]["warc-type"]
        complete = r["ok"] and "digest" in r and (kind == "revisit" or (r["bytes"] == r["length"] and r["sha"].hexdigest() == r["digest"]))
        self.done.append({"record_id": _id(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": kind, "refers_to": _id(h.get("warc-refers-to")), "payload_bytes": r.get("length", r["bytes"]), "payload_digest": r.get("digest", r["sha"].hexdigest()), "segments": r["segments"], "complete": complete})

    def take(self) -> list[dict]:
        done, self.done = self.done, []
        return done


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives under ``path``: ids, type, url, length, digest, segments, and whether all digests hold."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        reader, at = _Reader(), None
        schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("segments", pa.int32()), ("complete", pa.bool_())])
        for batch in batches:
            for file, line in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if file != at:
                    reader._flush()
                    done, reader, at = reader.take(), _Reader(), file
                    reader.done = done
                reader.line(line)
            if reader.done:
                yield pa.RecordBatch.from_pylist(reader.take(), schema=schema)
        reader._flush()
        if reader.done:
            yield pa.RecordBatch.from_pylist(reader.take(), schema=schema)

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(parse, _RECORD)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, chunk: int = CHUNK, path: str | None = None) -> DataFrame:
    """Write the archives of ``pages`` (to ``path`` or the shared folder) and return what reading them gives."""
    spark = pages.sparkSession
    bound_batches(spark)
    path = path or table_path(spark, "warc")
    write_archives(chunk_table(plan_records(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, least=least), chunk=chunk), path)
    read = read_archives(spark, path)
    kind = pages.schema[id_col].dataType
    return read.withColumns({"record_id": F.col("record_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).withColumnRenamed("record_id", id_col)
