"""WARC archives with a two-level capture index.

Writing: each task appends gzip members, one per record, to files of its own in the shared folder and reports where each
record lies; a repeated task writes new files and its old ones are never referred to. Payloads of at least ``SHARED``
bytes that occur more than once (equal SHA-1 and length) are stored once, by the largest page_id; the others are revisit
records that refer to it.

Index: capture lines are sorted by reversed-host URL key (``http://a.b.org/x`` is ``org,b,a)/x``) and range-parted;
every part is a file of compressed blocks of ``BLOCK`` lines. The sparse directory has one row per block, the top table
one per part. A lookup finds its parts by binary search in the top table (``part_size`` lines a part keep that table
small), its blocks by binary search in the part's directory, and reads just the bytes of those blocks; then just the bytes of the
records. A key with very many captures spans blocks and parts, so no task holds them all.

Defined cases: a null html is an empty payload; a null or empty url has the empty key; a url without ``://`` is its own
key; null page_ids are kept; equal rows are records of their own, and rows of the largest page_id with equal payloads are
all responses; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.session import ensure_checkpoint_dir
from folioscope.sources.storage import materialise

SHARED = 1000
BLOCK = 500
PART = 1_000_000
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, page_id {id}, path string, at long, size long"
_FIELD = "\t"


def open_folder(uri: str):
    """(file system, path) of a folder in any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def url_key(url: str | None) -> str:
    """Host parts reversed, then ``)`` and the rest of the url. Tabs and line breaks are escaped."""
    if not url:
        return ""
    _, mark, rest = url.partition("://")
    if not mark:
        key = url
    else:
        host = re.match(r"[^/?#]*", rest).group()
        key = ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host) :]
    return key.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def record_bytes(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One record: a response with its payload, or a revisit without (``refers_to`` is not None)."""
    header = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if url:
        header.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if refers_to is not None:
        header += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
        payload = b""
    header.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(header).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    payload = body[: int(fields["Content-Length"])]
    if body[len(payload) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return fields, payload


def judged(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, size, digest, refers_to: which page holds the payload of a revisit (else null)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    own = rows.select("page_id", "size", "digest")
    holders = own.where(F.col("size") >= SHARED).groupBy("digest", "size").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    revisits = own.join(holders, ["digest", "size"]).where("page_id <> holder").select("page_id", "digest", F.col("holder").alias("refers_to")).distinct()
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "size", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row; the captures (key, page_id, path, at, size), a stored table."""
    import pyarrow as pa

    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        store, root = open_folder(folder)
        out, path, at = None, None, 0
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "refers_to"))):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    path, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                raw = gzip.compress(record_bytes(*row), 4, mtime=0)
                out.write(raw)
                rows.append((url_key(row[1]), row[0], path, at, len(raw)))
                at += len(raw)
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.string(), batch.column("page_id").type, pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "page_id", "path", "at", "size"])
        if out is not None:
            out.close()

    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)
    return materialise(judged(pages).mapInArrow(run, CAPTURE.format(id=kind)), "captures")


def build_index(captures: DataFrame, folder: str, part_size: int = PART) -> DataFrame:
    """Write the compressed blocks; the directory (part, first, last, path, at, size), a stored table."""
    spark = captures.sparkSession
    n = captures.count()
    parts = max(-(-n // part_size), min(-(-n // BLOCK), 4 * spark.sparkContext.defaultParallelism), 1)
    rows = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches):
        from pyspark import TaskContext

        store, root = open_folder(folder)
        part = TaskContext.get().partitionId()
        path, out, at, lines, keys, directory = f"{root}/{uuid.uuid4().hex}.cdx.gz", None, 0, [], [], []

        def flush(out, at):
            if out is None:
                out = store.open_output_stream(path, compression=None)
            raw = zlib.compress("\n".join(lines).encode())
            out.write(raw)
            directory.append((part, keys[0], keys[-1], path, at, len(raw)))
            lines.clear(), keys.clear()
            return out, at + len(raw)

        for batch in batches:
            for row in zip(*(batch[c] for c in ("key", "page_id", "path", "at", "size"))):
                keys.append(row[0])
                lines.append(_FIELD.join([row[0], "" if pd.isna(row[1]) else str(int(row[1])), *map(str, row[2:])]))
                if len(lines) == BLOCK:
                    out, at = flush(out, at)
        if lines:
            out, at = flush(out, at)
        if out is not None:
            out.close()
        yield pd.DataFrame(directory, columns=["part", "first", "last", "path", "at", "size"])

    return materialise(rows.mapInPandas(run, "part int, first string, last string, path string, at long, size long"), "directory")


def lookup(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """The captures (key, page_id, path, at, size) of the distinct ``keys`` (column key), through the index."""
    spark = keys.sparkSession
    top = directory.groupBy("part").agg(F.min("first").alias("low"), F.max("last").alias("high")).orderBy("low", "part").collect()  # one row per part
    lows, highs, numbers = [r["low"] for r in top], [r["high"] for r in top], [r["part"] for r in top]
    told = spark.sparkContext.broadcast((lows, highs, numbers))

    def route(batches):
        lows, highs, numbers = told.value
        for batch in batches:
            found = []
            for key in batch["key"]:
                found += [(numbers[i], key) for i in range(bisect_left(highs, key), bisect_right(lows, key))]
            yield pd.DataFrame(found, columns=["part", "key"])

    def find(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values(["first", "at"])
        firsts, lasts = blocks["first"].tolist(), blocks["last"].tolist()
        needed: dict[int, list[str]] = {}
        for key in sorted(wanted["key"].tolist()):
            for i in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                needed.setdefault(i, []).append(key)
        found = []
        for i, own in needed.items():
            path, at, size = blocks[["path", "at", "size"]].iloc[i]
            store, _ = open_folder(path)
            with store.open_input_file(path) as file:
                lines = [x.split(_FIELD) for x in zlib.decompress(file.read_at(int(size), int(at))).decode().split("\n")]
            starts = [x[0] for x in lines]
            for key in own:
                found += [(key, int(x[1]) if x[1] else None, x[2], int(x[3]), int(x[4])) for x in lines[bisect_left(starts, key) : bisect_right(starts, key)]]
        out = pd.DataFrame(found, columns=["key", "page_id", "path", "at", "size"])
        return out.astype({"page_id": "Int64"})

    routed = keys.select("key").distinct().mapInPandas(route, "part int, key string")
    return routed.groupBy("part").cogroup(directory.groupBy("part")).applyInPandas(find, CAPTURE.format(id="long"))


def read_records(captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits) by range reads."""
    import pyarrow as pa

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = captures.repartition(parts, "path", F.floor(F.col("at") / (1 << 22))).sortWithinPartitions("path", "at")

    def run(batches):
        from hashlib import sha1

        name, file = None, None
        for batch in batches:
            rows = []
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size"))):
                if path != name:
                    file, name = open_folder(path)[0].open_input_file(path), path
                fields, payload = parse_record(gzip.decompress(file.read_at(size, at)))
                number = lambda field: None if (x := fields[field][len("<urn:x-page:") : -1]) == "None" else int(x)
                digest, held = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
                if held and (sha1(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
                    raise ValueError(f"damaged record in {path} at {at}")
                row = (number("WARC-Record-ID"), fields.get("WARC-Target-URI"), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], None if held else number("WARC-Refers-To"))
                rows.append((*row, payload if held else None) if with_payload else row)
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return near.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def archive_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, look every url up and read its records."""
    folder = archive_folder(pages.sparkSession)
    captures = write_archives(pages, folder)
    directory = build_index(captures, folder)
    return read_records(lookup(captures.select("key"), directory), with_payload=False)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM h
"""
