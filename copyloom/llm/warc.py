"""WARC archives: one gzip member per record, written and read back by tasks.

Writing: pages whose payload (the HTML in UTF-8) equals that of a page with a smaller id become `revisit` records without
a payload; payloads under `MIN_REVISIT_BYTES` are always stored. Each task writes archives of bounded size into the
shared folder. A file's name holds the task attempt and the manifest lists only files of attempts that ended well, so
that what a lost or repeated attempt has left is never counted.

Reading: a sequential reader inflates a file bit by bit, frames each record by its Content-Length, and verifies the
digests of block and payload and that record and gzip member end together.

Nulls and edge cases: a null HTML text is an empty payload; a null url leaves out WARC-Target-URI; a null page id is
larger than all others and leaves out its header field; repeated rows are records of their own, and equal rows with the
smallest id are all responses; an empty table gives no archive and no rows; further columns are ignored. A page must fit
in a task's memory, an archive need not: it is closed once it holds `archive_bytes`.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.session import cut, handover_path

ARCHIVE_BYTES = 16 << 20
MIN_REVISIT_BYTES = 100
READ_BYTES = 1 << 16
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "archive string, records long, bytes long"
READ_BACK = "archive string, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string"

# Fixed values of the format.
VERSION = b"WARC/1.1"
BREAK = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class DamagedArchive(ValueError):
    """An archive that is cut off, wrongly framed, or whose bytes do not match a digest."""


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]  # by field name in lower case
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header of a response; nothing in a revisit."""
        return self.block.partition(BREAK + BREAK)[2]


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _record_id(page_id: int | None, digest: str) -> str:
    name = f"page:{page_id}" if page_id is not None else f"payload:{digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record_member(headers: dict[str, str], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    fields = headers | {"WARC-Block-Digest": _digest(block), "Content-Length": str(len(block))}
    head = BREAK.join([VERSION, *(f"{k}: {v}".encode() for k, v in fields.items())])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head + BREAK + BREAK + block + BREAK + BREAK) + packer.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The record of one page, a revisit if it refers to another page."""
    http = HTTP_HEAD + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        headers["X-Page-Id"] = str(page_id)
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    if refers_to is None:
        return record_member(headers, http + payload)
    headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _record_id(refers_to, digest), "X-Refers-To-Page-Id": str(refers_to)}
    return record_member(headers, http)


def _members(stream: io.BufferedIOBase) -> Iterator[Iterator[bytes]]:
    """For each gzip member the pieces it inflates to. A member has to be read to its end before the next one."""
    waiting = stream.read(READ_BYTES)

    def pieces() -> Iterator[bytes]:
        nonlocal waiting
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not waiting:
                raise DamagedArchive("the archive ends inside a record")
            try:
                piece = inflate.decompress(waiting)
            except zlib.error as error:
                raise DamagedArchive(str(error)) from error
            waiting = inflate.unused_data or stream.read(READ_BYTES)
            if piece:
                yield piece

    while waiting:
        yield pieces()


def read_records(stream: io.BufferedIOBase) -> Iterator[Record]:
    """The records of an archive in order. Memory holds one record and one piece of the file."""
    for member in _members(stream):
        data = bytearray()
        while (end := data.find(BREAK + BREAK)) < 0:
            if (piece := next(member, None)) is None:
                raise DamagedArchive("a record without the end of its header")
            data += piece
        version, *lines = bytes(data[:end]).split(BREAK)
        if not version.startswith(b"WARC/"):
            raise DamagedArchive(f"not a record: {version[:20]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError) as error:
            raise DamagedArchive("a record without a length") from error
        for piece in member:
            data += piece
        block, rest = bytes(data[end + 4 : end + 4 + length]), bytes(data[end + 4 + length :])
        if len(block) != length or rest != BREAK + BREAK:
            raise DamagedArchive("the length of a record does not match its member")
        record = Record(headers, block)
        if headers.get("warc-block-digest", _digest(block)) != _digest(block):
            raise DamagedArchive("the digest of a block does not match")
        if record.kind == "response" and headers.get("warc-payload-digest", "") != _digest(record.payload):
            raise DamagedArchive("the digest of a payload does not match")
        yield record


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to: the smallest page id with the same payload, null for responses."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    copies = rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("digest")
    copies = copies.agg(F.min("page_id").alias("smallest"), F.count("*").alias("n")).where("n > 1 and smallest is not null")
    rows = rows.join(copies.drop("n"), "digest", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("smallest")), None).otherwise(F.col("smallest"))
    return rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _writer(folder: str, archive_bytes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        task, made = TaskContext.get(), 0
        out, name, records = None, "", 0

        def close() -> pd.DataFrame:
            size = out.tell()
            out.close()
            store.move(f"{root}/_{name}", f"{root}/{name}")
            return pd.DataFrame({"archive": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            for page_id, url, payload, digest, refers_to in batch.itertuples(index=False):
                if out is None:
                    name, made, records = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{made:05d}.warc.gz", made + 1, 0
                    out = store.open_output_stream(f"{root}/_{name}", compression=None)
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": _record_id(None, name), "WARC-Date": DATE, "WARC-Filename": name}
                    out.write(record_member(info | {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                out.write(page_member(page_id, url, payload, digest, refers_to))
                records += 1
                if out.tell() >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


def _plain(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for every page into `folder` and returns the manifest: archive, records, bytes."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    write = _writer(folder, archive_bytes)

    def with_plain_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def plain(batch: pd.DataFrame) -> pd.DataFrame:
            ids = {c: pd.Series([_plain(x) for x in batch[c]], index=batch.index, dtype=object) for c in ("page_id", "refers_to")}
            return batch.assign(**ids, url=batch.url.astype(object).where(batch.url.notna(), None))

        yield from write(plain(b) for b in batches)

    # Ids as text: a column of numbers with nulls would come as floating point numbers.
    rows = with_revisits(pages).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return cut(rows.mapInPandas(with_plain_ids, MANIFEST))


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """A row for every page record of the archives that the manifest lists, digests verified.

    Spark reads the files, one at a time, so the folder may be in any store it knows.
    """
    spark = manifest.sparkSession
    if not manifest.limit(1).count():
        return spark.createDataFrame([], READ_BACK)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in batch.itertuples(index=False):
                rows = []
                for record in read_records(io.BytesIO(content)):
                    if record.kind not in ("response", "revisit"):
                        continue
                    h = record.headers
                    rows.append(
                        (
                            path.rpartition("/")[2],
                            record.kind,
                            h.get("x-page-id"),
                            h.get("x-refers-to-page-id"),
                            h.get("warc-target-uri"),
                            int(h["x-payload-length"]) if record.kind == "revisit" else len(record.payload),
                            h["warc-payload-digest"].removeprefix("sha256:"),
                        )
                    )
                yield pd.DataFrame(rows, columns=["archive", "record_type", "page", "refers", "url", "payload_bytes", "payload_digest"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder).select("path", "content")
    schema = "archive string, record_type string, page string, refers string, url string, payload_bytes long, payload_digest string"
    rows = files.mapInPandas(read, schema).withColumns({"page_id": F.col("page").cast("long"), "refers_to": F.col("refers").cast("long")})
    return rows.join(manifest.select("archive"), "archive", "left_semi").select(*(f.split()[0] for f in READ_BACK.split(", ")))


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages to archives in the shared folder and returns what the archives hold."""
    folder = handover_path(pages.sparkSession, "warc")
    return read_archives(folder, write_archives(pages, folder, archive_bytes))
