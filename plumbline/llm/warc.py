"""WARC archives: written with an index, read back by coalesced byte ranges.

A task writes its records to an archive of its own in a shared folder, every record a gzip member
by itself, and returns where each lies. The index is a table of these places; an archive that the
index does not name (of a task that was lost or ran twice) is never read. Readers choose records
from the index, sort them by archive and offset, and read neighbouring ones in one go.

Archives are reached through ``pyarrow.fs``, so the folder may be a mounted path, HDFS or an
object store that it knows, wherever every executor can reach it.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.operators.staging import new_folder, stage

from .batches import SLICE

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {0}\r\n\r\n"

#: Smallest payload that a revisit may stand for.
WORTH_IT = 100
#: Bytes between two records that are read over rather than skipped, and the longest read that
#: takes in a further record.
GAP, READ = 64 * 1024, 4 * 1024 * 1024

INDEX = (
    "page_id bigint, archive string, offset bigint, length bigint, url string, digest string, "
    "payload_bytes bigint, record_type string, refers_to bigint"
)
RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, digest string, "
    "payload_bytes bigint, payload binary"
)


def record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def write_record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head and no payload."""
    block = HTTP_HEAD.format(len(payload)).encode() + (b"" if is_revisit else payload)
    fields = {
        "WARC-Type": REVISIT if is_revisit else RESPONSE,
        "WARC-Record-ID": record_name(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _one_line(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Refers-To": record_name(refers_to) if is_revisit else None,
        "WARC-Profile": PROFILE if is_revisit else None,
        "X-Page-Id": page_id,
        "X-Refers-To-Page-Id": refers_to if is_revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return gzip.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n", compresslevel=3, mtime=0)


def read_record(member: bytes) -> dict:
    """A record's fields and payload; an error when the payload does not match its digest."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == REVISIT
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-Id"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-Id"),
        "digest": digest,
        "payload_bytes": int(told["Content-Length"]),
        "payload": None if revisit else payload,
    }


def plan_revisits(pages: DataFrame, worth: int = WORTH_IT) -> DataFrame:
    """Adds ``refers_to`` and ``is_revisit`` to ``(page_id, url, payload, digest)``. Of equal
    payloads of at least ``worth`` bytes the smallest id is the response. Only digests are shuffled
    to find them, folded map-side; pages that are no revisit stay where they are unless the
    revisits are too many to be sent to each task."""
    digests = stage(pages.select("page_id", "digest", F.octet_length("payload").alias("size")), "payloads")
    large = digests.where(F.col("size") >= worth)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    again = (
        large.join(groups, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
        .distinct()
    )
    again = stage(again, "revisits")
    same = pages["page_id"].eqNullSafe(F.col("_page")) & (pages["digest"] == F.col("_digest"))
    return pages.join(again, same, "left").select(
        "page_id", "url", "payload", "digest", "refers_to", F.col("_digest").isNotNull().alias("is_revisit")
    )


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html",
    folder: str | None = None, date: str = "1970-01-01T00:00:00Z", worth: int = WORTH_IT,
) -> DataFrame:
    """Writes a record for every row and returns the index, itself written down:
    ``(page_id, archive, offset, length, url, digest, payload_bytes, record_type, refers_to)``.

    A null body is an empty payload; a null URL is left out; line ends inside a URL are escaped
    in the record and kept in the index. Rows that repeat an id are records of their own. Pages carry no time
    of capture, so ``date`` is written for all. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    planned = plan_revisits(rows.withColumn("digest", F.sha2("payload", 256)), worth)
    schema = to_arrow_schema(T.StructType.fromDDL(INDEX))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, offset = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                places = []
                for row in batch.slice(at, SLICE).to_pylist():
                    if out is None:
                        store, base = _store(folder)
                        store.create_dir(base, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    member = write_record(
                        row["page_id"], row["url"], row["payload"], row["digest"],
                        row["refers_to"], row["is_revisit"], date,
                    )
                    out.write(member)
                    places.append(
                        {
                            "page_id": row["page_id"], "archive": f"{folder}/{name}", "offset": offset,
                            "length": len(member), "url": row["url"], "digest": row["digest"],
                            "payload_bytes": len(row["payload"]),
                            "record_type": REVISIT if row["is_revisit"] else RESPONSE,
                            "refers_to": row["refers_to"],
                        }
                    )
                    offset += len(member)
                if places:
                    yield pa.RecordBatch.from_pylist(places, schema=schema)
        if out is not None:
            out.close()  # before the task ends, and so before its part of the index counts

    return stage(planned.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, gap: int = GAP, read: int = READ) -> DataFrame:
    """``(page_id, url, record_type, refers_to, digest, payload_bytes, payload)`` of the records
    whose index rows are given, all or any choice of them. A revisit's payload is null, its digest
    and size are those of the payload it stands for."""
    places = index.select("archive", "offset", "length")
    stretch = F.expr(f"offset div {read}")
    tasks = places.repartition("archive", stretch).sortWithinPartitions("archive", "offset")
    schema = to_arrow_schema(T.StructType.fromDDL(RECORD))

    def fetch(run: list[tuple[str, int, int]]) -> list[dict]:
        archive, begin = run[0][0], run[0][1]
        store, path = _store(archive)
        with store.open_input_file(path) as file:
            raw = file.read_at(run[-1][1] + run[-1][2] - begin, begin)
        return [read_record(raw[at - begin : at - begin + size]) for _, at, size in run]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple[str, int, int]] = []
        for batch in batches:
            for place in zip(*(column.to_pylist() for column in batch.columns)):
                if run:
                    archive, end = run[-1][0], run[-1][1] + run[-1][2]
                    near = place[0] == archive and place[1] - end <= gap
                    if not near or place[1] + place[2] - run[0][1] > read:
                        yield pa.RecordBatch.from_pylist(fetch(run), schema=schema)
                        run = []
                run.append(place)
        if run:
            yield pa.RecordBatch.from_pylist(fetch(run), schema=schema)

    return tasks.mapInArrow(work, RECORD)
