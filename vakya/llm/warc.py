"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; the last, skippable frame is the
seek table. The manifest maps every record to its frame and its place in it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialise, scratch_path

FRAME_BYTES = 1 << 16
#: A bundle is closed once it holds so much payload.
BUNDLE_BYTES = 64 << 20
#: Frames of a bundle that one task reads.
READ_FRAMES = 128
#: Fixed values of the seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"
MANIFEST = "page_id bigint, bundle string, frame int, frame_start bigint, frame_bytes bigint, record_start bigint, record_bytes bigint"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page_id: int | None, url: str, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:vakya:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}", "Content-Type: text/html",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:vakya:page:{'' if refers is None else refers}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + payload + b"\r\n\r\n"


class BundleWriter:
    """Frames of one bundle, kept compressed until the bundle is written whole."""

    def __init__(self):
        import zstandard as zs

        self.zs = zs.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.body, self.open, self.open_bytes, self.taken, self.rows = [], [], 0, 0, []

    def add(self, key: int | None, record: bytes) -> None:
        self.rows.append((key, len(self.frames), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        self.taken += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            c = self.zs.compress(b"".join(self.open))
            self.body.append(c)
            self.frames.append((len(c), self.open_bytes))
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        return b"".join(self.body) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, plain bytes) of every frame."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - i))
        out.append((at, c, d))
        at += c
    return out


def read_record(data: bytes, frame: int, start: int, size: int) -> bytes:
    """One record by its frame and frame-relative place; only that frame is decompressed."""
    import zstandard as zs

    at, c, d = seek_table(data)[frame]
    return zs.ZstdDecompressor().decompress(data[at : at + c], max_output_size=d)[start : start + size]


class BundleReader:
    """Random access to an open bundle: its seek table is read once, then single frames."""

    def __init__(self, file):
        import zstandard as zs

        self.file, self.zs = file, zs.ZstdDecompressor()
        size = file.size()
        file.seek(size - 9)
        n = struct.unpack("<IBI", file.read(9))[0]
        file.seek(size - 9 - 8 * n)
        self.frames = seek_table(file.read(9 + 8 * n))

    def frame(self, number: int) -> bytes:
        at, c, d = self.frames[number]
        self.file.seek(at)
        return self.zs.decompress(self.file.read(c), max_output_size=d)


def _parse(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in frame[at:end].decode("utf-8").split("\r\n")[1:])
        n = int(head["Content-Length"])
        yield head, frame[end + 4 : end + 4 + n]
        at = end + 8 + n


def _clean(url: str | None) -> str:
    return " ".join((url or "").split())


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Digest, size and role of every page; only ids and digests are shuffled.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the
    response and others revisit it; repeated rows of that id are responses too.
    A null page_id is a response only where no equal payload has an id.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload).alias("hex"))
    first = own.groupBy("hex").agg(F.min("page_id").alias("_first"), F.count("*").alias("n"))
    other = (F.col("payload_bytes") >= min_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return hot_join(own, first, "hex", pages.count()).select("page_id", "payload_bytes", "hex", F.when(other, F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write one record per row into bundles below ``folder``; returns the manifest.

    A bundle's name comes from its content, its partition and its number there, so
    bundles of equal records stay apart; it's moved into place whole, so a task
    that is run again writes the same files.
    """
    repeated = roles(pages, min_bytes).where("refers_to is not null").select("page_id", "hex", "refers_to").distinct()
    # The digest is computed again from the row at hand: html moves by page_id, which spreads it evenly.
    rows = (
        pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
        .withColumn("hex", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
        .alias("p").join(repeated.alias("r"), F.expr("p.page_id <=> r.page_id and p.hex = r.hex"), "left")
        .select("p.page_id", "p.url", "p.html", F.col("r.hex").isNotNull().alias("revisit"), "r.refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        w, task, numbers = BundleWriter(), TaskContext.get().partitionId(), count()

        def flush() -> pa.RecordBatch:
            data = w.finish()
            name = f"{base}/{hashlib.sha256(data).hexdigest()[:32]}-{task}-{next(numbers)}.warc.zst"
            part = f"{name}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(part, compression=None) as f:
                f.write(data)
            store.move(part, name)
            starts = [0]
            for c, _ in w.frames:
                starts.append(starts[-1] + c)
            cols = list(zip(*((k, name, f, starts[f], w.frames[f][0], at, n) for k, f, at, n in w.rows), strict=True))
            kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

        for b in batches:
            for page_id, url, html, revisit, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = (html or "").encode("utf-8", "replace")
                own = sha1_base32(payload)
                w.add(page_id, _record(page_id, _clean(url), payload, own, refers, revisit))
                if w.taken >= BUNDLE_BYTES:
                    yield flush()
                    w = BundleWriter()
        if w.rows:
            yield flush()

    return materialise(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Fetch every record of a manifest from its bundle, by its frame and its place in it.

    The manifest is dealt by bundle and stretch of frames to as many tasks as there are stretches, so
    that a task reads about READ_FRAMES frames, each once.
    """
    stretch = F.floor(F.col("frame") / READ_FRAMES)
    places = manifest.select("bundle", "frame", "record_start", "record_bytes", stretch.alias("stretch"))
    parts = max(1, places.select("bundle", "stretch").distinct().count())
    dealt = places.repartition(parts, "bundle", "stretch").sortWithinPartitions("bundle", "frame", "record_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        open_name, open_frame, reader, frame = None, None, None, b""
        for b in batches:
            out = []
            for name, number, start, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if name != open_name:
                    if reader is not None:
                        reader.file.close()
                    reader, open_name, open_frame = BundleReader(store.open_input_file(name)), name, None
                if number != open_frame:
                    frame, open_frame = reader.frame(number), number
                for head, payload in _parse(frame[start : start + size]):
                    revisit = head["WARC-Type"] == "revisit"
                    key, ref = (head.get(k, "").rpartition(":")[2].rstrip(">") for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else sha1_base32(payload)
                    out.append((int(key) if key else None, int(head["X-Payload-Bytes"]) if revisit else len(payload), digest, head["WARC-Type"], int(ref) if ref else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if reader is not None:
            reader.file.close()

    return dealt.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write bundles to the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder, min_bytes), folder)
