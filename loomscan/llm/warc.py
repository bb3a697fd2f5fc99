"""WARC writing and reading (operator 4): one Zstandard frame a record, with an embedded dictionary."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicFile, bounded, dealt_join, materialize, open_fs, partitions, scratch, ship, table, workspace

DICT_MAGIC = 0x184D2A5D  # the skippable frame in which .warc.zst files carry their dictionary
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 8192  # bytes a frame is given at once


def dictionary_of(samples: list[bytes], size: int, level: int) -> bytes:
    """A Zstandard dictionary trained on records; where they are too few or too small to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Writer:
    """Writes a .warc.zst file.

    The first records, up to sample_bytes of them, are held back; the dictionary is trained on their heads of up to
    sample_each bytes and goes first, in a skippable frame. Then each record is compressed as a frame of its own, so
    any record can be read with the dictionary and its offset alone.
    """

    def __init__(self, uri: str, dict_bytes: int = 65_536, sample_bytes: int = 4_000_000, sample_each: int = 65_536, level: int = 3, date: str | None = None):
        self.file, self.level = AtomicFile(uri), level
        self.dict_bytes, self.sample_bytes, self.sample_each = dict_bytes, sample_bytes, sample_each
        self.held: list[bytes] | None = []
        self.n_held = 0
        self.add(record("warcinfo", uuid.uuid5(uuid.NAMESPACE_URL, uri).urn, date or now(), [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def add(self, data: bytes) -> None:
        if self.held is None:
            self.file.out.write(self.compressor.compress(data))
            return
        self.held.append(data)
        self.n_held += len(data)
        if self.n_held >= self.sample_bytes:
            self._start()

    def _start(self) -> None:
        held, self.held = self.held, None
        trained = dictionary_of([x[: self.sample_each] for x in held], self.dict_bytes, self.level)
        self.file.out.write(struct.pack("<II", DICT_MAGIC, len(trained)) + trained)
        self.compressor = zstandard.ZstdCompressor(level=self.level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(trained))
        for x in held:
            self.add(x)

    def close(self) -> None:
        if self.held is not None:
            self._start()
        self.file.commit()


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(kind: str, record_id: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_records(uri: str, block: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a .warc.zst file, a frame at a time.

    A frame is given few bytes at once, so what it leaves over is little, and work grows with the file's length.
    """
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICT_MAGIC:
            raise ValueError(f"{uri}: no dictionary frame")
        trained = f.read(size)
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
        held, at = memoryview(f.read(block)), 0
        while len(held):
            frame, parts = d.decompressobj(), []
            while not frame.eof:
                if at == len(held):
                    held, at = memoryview(f.read(block)), 0
                    if not len(held):
                        raise ValueError(f"{uri}: the last record is cut off")
                some = held[at : at + STEP]
                parts.append(frame.decompress(some))
                at += len(some) - len(frame.unused_data)
            yield parse(b"".join(parts))
            if at == len(held):
                held, at = memoryview(f.read(block)), 0


def _clean(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "") or "urn:none"


def _digest(payload: Column) -> Column:
    return F.sha1(payload)


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", min_bytes: int = 1000) -> DataFrame:
    """Rows (id, digest, target, target_url): pages that become revisits, and the page whose payload they repeat.

    Of pages with equal payloads of at least min_bytes, those with the largest id are responses. Counts are taken by
    digest before anything is joined, and a payload that very many pages share is dealt over tasks. With one row of an
    id and payload for all rows that repeat them.
    """
    x = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"))
    x = x.select("id", "url", F.octet_length("payload").alias("n"), _digest(F.col("payload")).alias("digest")).filter(F.col("n") >= min_bytes)
    shared = x.groupBy("digest").agg(F.max("id").alias("target"), F.max(F.struct("id", "url")).alias("of"), F.count("*").alias("w")).filter("w > 1 and target is not null")
    shared = materialize(shared.select("digest", "target", F.col("of.url").alias("target_url"), "w"), "warc-shared")
    total = shared.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    revisits = dealt_join(x.select("id", "digest"), shared, "digest", "w", total)
    return revisits.filter("id is null or id < target").select("id", "digest", "target", "target_url").distinct()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000, date: str | None = None) -> DataFrame:
    """Archive pages, one .warc.zst file a task; returns the files: uri, n_records.

    Equal payloads are stored once (see decide); other pages with them become revisit records with the payload's digest
    and the response's URI and date, the references of WARC 1.1. All records have the date given, that of the call by
    default. Null html is an empty payload, rows that repeat a page are records each, other columns are ignored; an
    empty table gives no files.
    """
    spark = pages.sparkSession
    ship(spark)
    date = date or now()
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    with workspace(spark):
        revisits = bounded(materialize(decide(rows, "id", "url", min_bytes).toDF("r_id", "r_digest", "target", "target_url"), "warc-revisits"))
        same = F.col("id").eqNullSafe(F.col("r_id")) & (_digest(F.encode("html", "utf-8")) == F.col("r_digest"))
        rows = rows.join(revisits, same, "left").select("id", "url", "html", "target", "target_url")

        def run(batches):
            out, n = None, 0
            uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.zst"
            for batch in batches:
                for i in range(batch.num_rows):
                    page, url, html, target, target_url = (batch.column(k)[i].as_py() for k in range(5))
                    payload = html.encode()
                    out = out or Writer(uri, date=date)
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    fields = [("WARC-Target-URI", _clean(url)), ("X-Page-Id", "" if page is None else str(page)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                    name = uuid.uuid5(uuid.NAMESPACE_OID, f"{uri}#{n}").urn
                    if target is None:
                        out.add(record("response", name, date, fields, HTTP + payload))
                    else:
                        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To-Target-URI", _clean(target_url)), ("WARC-Refers-To-Date", date)]
                        out.add(record("revisit", name, date, fields, HTTP))
                    n += 1
            if out:
                out.close()
                yield pa.RecordBatch.from_pydict({"uri": [uri], "n_records": pa.array([n], pa.int64())})

        rows.mapInArrow(run, "uri string, n_records long").write.parquet(f"{folder}/manifest")
    return spark.read.schema("uri string, n_records long").parquet(f"{folder}/manifest")


def read_warc(files: DataFrame) -> DataFrame:
    """One row per record read from archives (column uri): page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length come from the stored payload; a digest in its header that is another is an error. A
    revisit has the digest of its header, and is resolved by it: length and page are those of the response with this
    digest and the URI it refers to, null if the archives hold none.
    """
    spark = files.sparkSession
    ship(spark)

    def rows(uri: str) -> Iterator[tuple]:
        for fields, block in read_records(uri):
            if (kind := fields["WARC-Type"]) == "warcinfo":
                continue
            page = int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None
            digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            if kind == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                if hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{uri}: the payload of {fields['WARC-Record-ID']} isn't what its digest says")
                yield page, fields["WARC-Target-URI"], len(payload), digest, kind, None
            else:
                yield page, fields["WARC-Target-URI"], None, digest, kind, fields["WARC-Refers-To-Target-URI"]

    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to_url": pa.string()}

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                some: list[tuple] = []
                for row in rows(uri):
                    some.append(row)
                    if len(some) == 4096:
                        yield pack(some)
                        some = []
                if some:
                    yield pack(some)

    def pack(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), kinds.values())], names=list(kinds))

    dealt = files.select("uri").repartition(partitions(spark), "uri")
    with workspace(spark):
        found = materialize(dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to_url string"), "warc-rows", keep=True)
        revisits, responses = found.filter("record_type = 'revisit'").drop("payload_bytes"), found.filter("record_type = 'response'")
        wanted = materialize(revisits.groupBy("payload_digest").agg(F.count("*").alias("w")), "warc-wanted")
        named = responses.join(bounded(wanted), "payload_digest").groupBy("payload_digest", F.col("url").alias("named_url")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("w").alias("w"))
        named = materialize(named.groupBy("payload_digest", "w").agg(F.max_by(F.struct("named_url", "refers_to", "payload_bytes"), F.coalesce("refers_to", F.lit(-(1 << 63)))).alias("x")), "warc-named", keep=True)
        total = wanted.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    solved = dealt_join(revisits, named, "payload_digest", "w", total, "left")
    there = F.col("x.named_url") == F.col("refers_to_url")
    revisits = solved.select("page_id", "url", F.when(there, F.col("x.payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", F.when(there, F.col("x.refers_to")).alias("refers_to"))
    return responses.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(revisits)


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc"))).drop("url")


QUERIES = {"op4_warc_dictionary": op4_warc_dictionary}
ORACLES = {
    "op4_warc_dictionary": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS target FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT p.*, CASE WHEN p.page_id IS DISTINCT FROM m.target AND m.target IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM m.target THEN m.target END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes >= 1000
"""
}
