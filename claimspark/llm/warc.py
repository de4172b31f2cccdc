"""WARC records in ZIP-packaged archives: stored members and an index, read back by ranges without extraction."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.scratch import slots

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed, so that a rerun writes the same bytes.
DATE = "2024-01-01T00:00:00Z"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI as Spark writes it; an error for a scheme that tasks can't reach.

    Tasks open archives themselves, to read ranges of them. ``s3a`` and ``s3n`` are S3, ``dbfs`` is the folder that all machines
    of such a cluster mount, ``abfs(s)`` and ``wasb(s)`` are Azure, ``hdfs`` and ``viewfs`` need Hadoop's client on the workers.
    For any other store pass an opener of your own wherever a folder is written or read.
    """
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest)
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme in ("s3", "s3a", "s3n"):
        return fs.S3FileSystem(), rest.lstrip("/")
    if scheme in ("abfs", "abfss", "wasb", "wasbs"):
        container, _, place = rest.lstrip("/").partition("@")
        host, _, path = place.partition("/")
        return fs.AzureFileSystem(account_name=host.split(".")[0]), f"{container}/{path}"
    if scheme in ("hdfs", "viewfs", "gs"):
        return fs.FileSystem.from_uri(uri)
    raise ValueError(f"tasks can't reach {scheme}: pass an opener for {uri}")


Opener = Callable[[str], tuple[fs.FileSystem, str]]


def with_record_types(
    pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is the response; the
    others revisit it. Firsts are counted per digest with partial aggregation; they are grouped by length as well, so the
    join has a shuffle of its own on both sides and adaptive execution can split a payload that many pages share.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    ).select(
        "*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    firsts = (
        rows.groupBy("payload_digest", "payload_bytes")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where((F.col("payload_bytes") >= least_bytes) & (F.col("n") > 1))
        .select("payload_digest", "first_id")
    )
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        rows.join(firsts, "payload_digest", "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("first_id")))
        .drop("first_id")
    )


def urn(page_id: str | None) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:id:{quote(page_id, safe='')}>"


def from_urn(text: str | None) -> str | None:
    return unquote(text[len("<urn:page:id:") : -1]) if text and text.startswith("<urn:page:id:") else None


def record(page_id: str | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers: str | None) -> bytes:
    """One record; a revisit has no block, its payload is that of the record it refers to."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe='/:?#[]@!$&()*+,;=%~._-')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {urn(refers)}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    records: DataFrame, folder: str, archive_bytes: int = 64 << 20, level: int = 1, opener: Opener = open_store
) -> DataFrame:
    """Write the rows of ``with_record_types`` below ``folder`` and return path, records and bytes of each archive.

    Every task writes archives of its own, a new one after ``archive_bytes``. An archive is a ZIP file of stored members:
    the records, each compressed alone so that it can be read alone, and an index with a line for each. File names
    hold the attempt's number and only successful attempts are in the result, so a lost executor leaves files that
    nobody reads but no wrong rows. ``folder`` is a URI that all executors reach, through ``opener``; one that it doesn't know
    fails here, before anything is written.
    """
    opener(folder)
    rows = records.select(
        F.col("page_id").cast("string").alias("page_id"), "url", F.col("payload").cast("binary").alias("payload"),
        "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("string").alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0
        store, root = opener(folder)
        store.create_dir(root, recursive=True)

        def flat() -> Iterator[tuple]:
            for batch in batches:
                for values in zip(*batch.columns, strict=True):
                    page_id, url, payload, size, digest, kind, refers = values
                    yield (
                        page_id.as_py(), url.as_py(), payload.as_buffer().to_pybytes(), size.as_py(), digest.as_py(),
                        kind.as_py(), refers.as_py(),
                    )

        rest = flat()
        row = next(rest, None)
        while row is not None:
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.zip"
            index, offset = [], 0
            with store.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                with package.open(DATA_MEMBER, "w", force_zip64=True) as member:
                    while row is not None and offset < archive_bytes:
                        body = gzip.compress(record(*row), level, mtime=0)
                        member.write(body)
                        index.append(json.dumps({"id": row[0], "offset": offset, "length": len(body)}))
                        offset += len(body)
                        row = next(rest, None)
                package.writestr(INDEX_MEMBER, "\n".join(index))
            number += 1
            yield pa.RecordBatch.from_pydict({"name": [name], "records": [len(index)], "bytes": [offset]})

    done = rows.mapInArrow(write, "name string, records bigint, bytes bigint")
    path = f"{folder}/manifest.parquet"
    done.write.parquet(path)
    return done.sparkSession.read.schema(done.schema).parquet(path).select(
        F.concat(F.lit(f"{folder}/"), "name").alias("path"), "records", "bytes"
    )


def members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """(method, first byte, bytes) of each member, from the directories alone; ``read(at, n)`` gives a range of the file."""
    tail_at = max(0, size - 65_557)  # the end record and its longest comment
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if count == 0xFFFF or 0xFFFFFFFF in (length, start):
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("ZIP64 locator missing")
        (at,) = struct.unpack("<Q", locator[8:16])
        big = read(at, 56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end of central directory missing")
        count, length, start = struct.unpack("<QQQ", big[32:56])
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory broken")
        method = struct.unpack("<H", directory[at + 10 : at + 12])[0]
        packed, full, n_name, n_extra, n_note = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        header = struct.unpack("<I", directory[at + 42 : at + 46])[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:  # ZIP64 values stand in this order, each only if its 32-bit field is full
            tag, width = struct.unpack("<HH", extra[:4])
            if tag == 1:
                values = list(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                header = values.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + width :]
        local = read(header, 30)
        skip = sum(struct.unpack("<HH", local[26:30]))
        found[name] = (method, header + 30 + skip, packed)
        at += 46 + n_name + n_extra + n_note
    return found


def record_ranges(archives: DataFrame, range_bytes: int = 4 << 20, opener: Opener = open_store) -> DataFrame:
    """path, first byte and bytes of runs of whole records of about ``range_bytes``, from directories and indexes."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = opener(path)
                with store.open_input_file(name) as file:
                    found = members(lambda at, n, f=file: f.read_at(n, at), file.size())
                    for name in (DATA_MEMBER, INDEX_MEMBER):
                        if name not in found or found[name][0] != zipfile.ZIP_STORED:
                            raise ValueError(f"{path}: {name} is missing or not stored")
                    base, index = found[DATA_MEMBER][1], found[INDEX_MEMBER]
                    lines = file.read_at(index[2], index[1]).decode().splitlines()
                spans = [(x["offset"], x["length"]) for x in map(json.loads, lines)]
                out, at = [], 0
                for k, (offset, length) in enumerate(spans):
                    if offset + length - at >= range_bytes or k == len(spans) - 1:
                        out.append({"path": path, "first": base + at, "bytes": offset + length - at})
                        at = offset + length
                yield pa.RecordBatch.from_pylist(
                    out, pa.schema([("path", pa.string()), ("first", pa.int64()), ("bytes", pa.int64())])
                )

    return archives.select("path").mapInArrow(locate, "path string, first bigint, bytes bigint")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_archives(archives: DataFrame, opener: Opener = open_store) -> DataFrame:
    """One row per record: page_id, record_type, refers_to (text ids), target_uri, payload (null for a revisit),
    payload_bytes and payload_digest of the full payload.

    Archives are located first and dealt out again by ranges, so a long archive is read by many tasks. Only the
    directories, the index and the ranges are read. A response whose payload doesn't have the digest of its header is an
    error, so is a broken directory.
    """
    ranges = record_ranges(archives, opener=opener).repartition(slots(archives.sparkSession))
    names = ["page_id", "record_type", "refers_to", "target_uri", "payload", "payload_bytes", "payload_digest"]
    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = opener(path)
                with store.open_input_file(name) as file:
                    raw = file.read_at(size, first)
                rows = []
                while raw:
                    unpack = zlib.decompressobj(31)
                    fields, block = parsed(unpack.decompress(raw))
                    raw = unpack.unused_data
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"{path}: {fields['WARC-Record-ID']} doesn't have its digest")
                    rows.append(
                        dict(
                            zip(
                                names,
                                (
                                    from_urn(fields["WARC-Record-ID"]), kind, from_urn(fields.get("WARC-Refers-To")),
                                    fields["WARC-Target-URI"], block if kind == "response" else None,
                                    len(block) if kind == "response" else int(fields["WARC-Payload-Length"]), digest,
                                ),
                                strict=True,
                            )
                        )
                    )
                yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(
        read,
        "page_id string, record_type string, refers_to string, target_uri string, payload binary, payload_bytes bigint, "
        "payload_digest string",
    )


def round_trip(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    opener: Opener = open_store,
) -> DataFrame:
    """Archive ``pages`` below ``folder``, read the archives back, and describe each record.

    A null payload is empty. A null id sorts after all others: such a page is a response unless its payload stands under
    an id as well. Rows that repeat the smallest id of a payload are all responses. Ids keep their type.
    """
    kind = pages.schema[id_col].dataType
    records = with_record_types(pages, id_col=id_col, url_col=url_col, payload_col=payload_col)
    found = read_archives(write_archives(records, folder, opener=opener), opener)
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
