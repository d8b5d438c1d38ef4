"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding some WARC records, and a last skippable frame with
the seek table of the public seekable format. Plain ``zstd -d`` reads a bundle as one WARC file; the index maps a
record to its bundle, frame and place in the frame, so one record costs one frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir, sized, table

#: Bytes of records after which a frame ends, and of frames after which a bundle ends. A record is never cut.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28
LEVEL = 3
#: Smallest payload of which copies become revisits.
LEAST_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

INDEX = "page_id long, record_type string, refers_to long, path string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
READ = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, header_digest string"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, size: int, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit (identical payload digest profile) has the HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URI)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    if page_id is not None:
        head.append(f"WARC-Page: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI = "".join(map(chr, range(33, 127)))


def parse(data: bytes) -> dict:
    """Headers, block and HTTP body of one record; a record that is cut or malformed raises ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size + 4 or rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("the record is cut")
    http, _, body = rest[:size].partition(b"\r\n\r\n")
    length = re.search(rb"Content-Length: (\d+)", http)
    return {"headers": headers, "body": body, "size": int(length[1]) if length else len(body)}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, raw) bytes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Frames of (compressed, raw) bytes, from the end of a bundle."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE_MAGIC or len(tail) < 9 + 8 * n:
        raise ValueError("no seek table, or a longer one")
    return [struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (n - i)) for i in range(n)]


def planned(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Pages with payload digest, record type and the page that a revisit refers to.

    Of equal payloads the largest page_id is the response, of several rows with that id the one of the least url (a
    null url last); rows that are wholly alike are counted, and one of them is the response. Payloads without any
    page_id are all responses, as none can be referred to. Only digests, ids and urls are aggregated; the digests that
    occur more than once are broadcast while they are few, so that pages need not be shuffled.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.unhex(F.sha1(html)).alias("key"), F.octet_length(html).cast("long").alias("size"))
    place = F.struct(-F.col("page_id"), F.col("url").isNull(), "url")
    by_place = keyed.where("page_id IS NOT NULL").groupBy("key", "page_id", "url").agg(F.count("*").alias("n"))
    last = (
        by_place.groupBy("key").agg(F.max("page_id").alias("response"), F.min_by(F.struct("url", "n"), place).alias("at"), F.sum("n").alias("copies"))
        .select(F.col("key").alias("last_key"), "response", F.col("at.url").alias("response_url"), F.col("at.n").alias("alike"), "copies")
    )
    some = keyed.where("page_id IS NULL").select("key").distinct()
    last = last.join(some.withColumnRenamed("key", "last_key").withColumn("loose", F.lit(True)), "last_key", "left").where("copies > 1 OR loose").drop("copies", "loose")
    joined = keyed.join(sized(last, F.octet_length("last_key") + F.coalesce(F.octet_length("response_url"), F.lit(0)).cast("long")), F.col("key") == F.col("last_key"), "left")
    first = F.col("page_id").eqNullSafe(F.col("response")) & F.col("url").eqNullSafe(F.col("response_url"))
    revisit = F.coalesce((F.col("size") >= least_revisit) & F.col("response").isNotNull() & ~first, F.lit(False))
    marked = joined.withColumn("revisit", revisit)
    # of n rows wholly alike that are the response, one is kept and stands for all: a response and n - 1 revisits
    tied = marked.where((F.col("alike") > 1) & first & (F.col("size") >= least_revisit))
    one = tied.groupBy("key", "page_id", "url", "response", "size").agg(F.first("html").alias("html"), F.count("*").alias("n"))
    again = one.select("page_id", "url", "html", "size", "response", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")).withColumn("revisit", F.col("i") > 1)
    columns = ["page_id", "url", "html", "size", "revisit", F.when(F.col("revisit"), F.col("response")).alias("refers_to")]
    plain = marked.where(~F.coalesce((F.col("alike") > 1) & first & (F.col("size") >= least_revisit), F.lit(False)))
    if last.where("alike > 1").isEmpty():
        return plain.select(*columns)
    return plain.select(*columns).unionAll(again.select(*columns))


def write(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write planned pages to bundles in ``folder`` (any URI that ``pyarrow.fs`` opens) and return the index.

    Every task writes its own bundles under names that no other attempt uses, so a lost executor or a repeated task
    leaves at most a bundle that the index does not name. A task holds one frame at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        out, name, offset = None, "", 0
        frames: list[tuple[int, int]] = []
        raw, held, size = [], [], 0

        def end_frame() -> pd.DataFrame:
            nonlocal raw, held, size, offset
            data = squeeze.compress(b"".join(raw))
            out.write(data)
            done = pd.DataFrame(held, columns=["page_id", "record_type", "refers_to", "record_offset", "record_bytes"]).astype({"page_id": "Int64", "refers_to": "Int64"})
            done = done.assign(path=f"{folder}/{name}", frame=len(frames), frame_offset=offset, frame_bytes=len(data))
            frames.append((len(data), size))
            offset += len(data)
            raw, held, size = [], [], 0
            return done[[x.split()[0] for x in INDEX.split(", ")]]

        def end_bundle() -> None:
            nonlocal out, frames, offset
            out.write(seek_table(frames))
            out.close()
            out, frames, offset = None, [], 0

        for pdf in batches:
            for page_id, url, html, n, revisit, refers_to in zip(*(pdf[c] for c in ("page_id", "url", "html", "size", "revisit", "refers_to")), strict=True):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                data = record(page_id, url if isinstance(url, str) else None, payload, digest_of(payload), refers_to, bool(revisit), int(n))
                if out is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                held.append((page_id, "revisit" if revisit else "response", refers_to, size, len(data)))
                raw.append(data)
                size += len(data)
                if size >= frame_bytes:
                    yield end_frame()
                    if offset >= bundle_bytes:
                        end_bundle()
        if out is not None:
            if held:
                yield end_frame()
            end_bundle()

    return pages.select("page_id", "url", "html", "size", "revisit", "refers_to").mapInPandas(run, INDEX)


def open_bundle(files, path: str) -> tuple[object, list[int]]:
    """A bundle and where its frames start, with their end, from the seek table in its last bytes."""
    source = files.open_input_file(path)
    size = source.size()
    source.seek(max(0, size - 9))
    n = struct.unpack("<IBI", source.read(9))[0]
    source.seek(max(0, size - 9 - 8 * n))
    starts = [0]
    for packed, _ in read_seek_table(source.read(9 + 8 * n)):
        starts.append(starts[-1] + packed)
    if starts[-1] + 17 + 8 * n != size:
        raise ValueError(f"{path}: the seek table does not fit the bundle")
    return source, starts


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that an index names, each read at its place: its frame by the bundle's own seek table, and in it by
    offset. A frame is fetched and opened once for those of its records that come together.

    A frame whose place differs from the index, and a response whose payload does not match its digest, fail the task.
    A revisit has no payload; its digest is the one that it states. Columns besides the index's are dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyarrow import fs

        stretch = zstandard.ZstdDecompressor()
        path, source, starts, place, frame = None, None, [], None, b""
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.path != path:
                    files, base = fs.FileSystem.from_uri(r.path)
                    if source is not None:
                        source.close()
                    path, place = r.path, None
                    source, starts = open_bundle(files, base)
                if r.frame != place:
                    place = r.frame
                    if starts[place] != r.frame_offset or starts[place + 1] - starts[place] != r.frame_bytes:
                        raise ValueError(f"{r.path}: frame {place} is not where the index has it")
                    source.seek(starts[place])
                    frame = stretch.decompress(source.read(starts[place + 1] - starts[place]))
                found = parse(frame[r.record_offset : r.record_offset + r.record_bytes])
                head, kind = found["headers"], found["headers"]["warc-type"]
                stated = head["warc-payload-digest"].removeprefix("sha1:")
                own = digest_of(found["body"]) if kind == "response" else stated
                if own != stated or kind == "response" and len(found["body"]) != found["size"]:
                    raise ValueError(f"{r.path}: the payload of page {r.page_id} does not match its record")
                page, refers = head.get("warc-page"), head.get("warc-refers-to-page")
                rows.append((None if page is None else int(page), head.get("warc-target-uri"), kind, None if refers is None else int(refers), found["body"] if payloads and kind == "response" else None, found["size"], own, stated))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.select(*(x.split()[0] for x in INDEX.split(", "))).mapInPandas(run, READ)


def archive(pages: DataFrame, folder: str | None = None, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to bundles and return their index, itself kept in the shared folder.

    A null html is an empty payload, a null url leaves out the target; repeated rows are records of their own. An
    empty table writes no bundle and gives an empty index. Other columns of ``pages`` are not archived. A payload has
    less than 4 GiB, the most that a frame of the format may hold (and twice what a string of Spark holds).
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else re.sub("^(file:)?/+", "file:///", folder)
    return checkpointed(write(planned(pages, least_revisit), folder))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page's record says when it is read back from the archives; null html is an empty payload.

    An empty table gives no rows, a null page_id is a record without the page's number.
    """
    index = archive(table(spark, sf_dir, "pages"))
    return read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc": op4_warc}

_LETTERS = " || ".join(
    f"substr('{_BASE32}', ((CAST('0x' || substr(key, {5 * k + 1}, 5) AS INTEGER) >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0)
)
SQL = {
    "op4_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS key FROM pages),
last AS (SELECT key, max(page_id) AS response FROM p GROUP BY key)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
       CASE WHEN page_id <> response AND n >= {LEAST_REVISIT} THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> response AND n >= {LEAST_REVISIT} THEN response END AS refers_to
FROM p JOIN last USING (key)
"""
}
