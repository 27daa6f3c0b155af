"""Web archives compressed with Zstandard: one dictionary per file, one frame per record.

A file starts with a skippable frame that holds the dictionary; every record is a frame of
its own, compressed with it. Records are WARC/1.1: of equal payloads one is a response, and
the others are revisit records that name it and keep its HTTP header, so their length
survives. The reader streams a file frame by frame, loads the dictionary from the leading
frame, and checks headers, lengths and digests; a record that fails is returned with what
is wrong instead of its payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import materialize, shared_folder

#: magic numbers of a Zstandard frame and of the skippable frame of a dictionary
FRAME_MAGIC, DICTIONARY_MAGIC = 0xFD2FB528, 0x184D2A5D
#: a file is closed when its payloads have reached this many bytes
FILE_BYTES = 32_000_000
#: payload bytes that a dictionary is trained on, and its size
SAMPLE_BYTES, DICTIONARY_BYTES = 1_000_000, 32_768
#: the least number of records that a dictionary can be trained on
SAMPLE_RECORDS = 16
LEVEL = 3
#: keys of repeated payloads that are copied to the executors at most (some 60 bytes each)
COPIED_KEYS = 500_000
READ_BYTES = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: tasks that read archives, at most
MOST_READERS = 10_000
RECORD_SCHEMA = (
    "file string, offset long, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary, error string"
)
_RECORD_NAMES = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]


def payload_digest(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(key: object) -> str:
    return f"<urn:page:{'none' if key is None else key}>"


def _safe(value: str) -> str:
    """A header value without line breaks and other control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(key: object, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record: a response, or a revisit of the record id ``refers_to``."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode("ascii")
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {_safe(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join([*lines, "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


# -- writing -------------------------------------------------------------------------------


class _File:
    """An archive being written: records wait until the dictionary can be trained."""

    def __init__(self, folder: str) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        system, path = fs.FileSystem.from_uri(_uri(folder))
        system.create_dir(path, recursive=True)
        self.out = system.open_output_stream(f"{path}/{self.name}")
        self.waiting: list[bytes] = []
        self.payload_bytes = self.records = 0
        self.frames: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes, payload_bytes: int) -> None:
        self.records += 1
        self.payload_bytes += payload_bytes
        if self.frames is not None:
            self.out.write(self.frames.compress(record))
            return
        self.waiting.append(record)
        if self.payload_bytes >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        dictionary = None
        if len(self.waiting) >= SAMPLE_RECORDS:
            try:
                dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting)
            except zstandard.ZstdError:
                dictionary = None  # too little or too uniform data; frames go without one
        if dictionary is not None:
            data = dictionary.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        self.frames = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True
        )
        for record in self.waiting:
            self.out.write(self.frames.compress(record))
        self.waiting.clear()

    def close(self) -> None:
        if self.frames is None:
            self._start()
        self.out.close()


def _uri(folder: str) -> str:
    return folder if re.match(r"[a-z0-9+.-]+:", folder) else f"file://{folder}"


def with_revisits(df: DataFrame, key: str, payload: Column, least: int = 0) -> DataFrame:
    """Add ``_payload`` (bytes), ``_revisit`` and ``_refers_to`` (the largest key of an equal payload).

    Payloads shorter than ``least`` bytes are never revisits. Equal payloads are found by
    SHA-1 in rows of key and digest alone. The keys of payloads that occur again are copied to
    the executors up to ``COPIED_KEYS``, and no payload moves; beyond that the payloads move
    once, by key, so a hot payload is dealt to many tasks. Rows with a null key come after all
    others; rows that share key and payload are alike.
    """
    rows = df.withColumn("_payload", F.coalesce(payload, F.lit("")).cast("binary"))
    rows = rows.withColumn("_sha1", F.sha1("_payload"))
    keys = rows.select(F.col(key).alias("_key"), "_sha1").distinct()
    firsts = keys.groupBy("_sha1").agg(F.max("_key").alias("_first"), F.count("*").alias("_n"))
    copies = firsts.filter("_n > 1").select("_sha1", "_first")
    decided = materialize(
        keys.join(copies, "_sha1").select(
            F.col("_sha1").alias("_same"), F.col("_key").alias("_whose"), "_first"
        ),
        "page-copies",
    )
    small = decided.count() <= COPIED_KEYS
    joined = rows.join(
        F.broadcast(decided) if small else decided,
        F.col(key).eqNullSafe(F.col("_whose")) & (F.col("_sha1") == F.col("_same")),
        "left",
    )
    again = (
        F.col("_same").isNotNull()
        & ~F.col(key).eqNullSafe(F.col("_first"))
        & (F.length("_payload") >= least)
    )
    return (
        joined.withColumn("_revisit", again)
        .withColumn("_refers_to", F.when(again, F.col("_first")))
        .drop("_sha1", "_same", "_whose", "_first")
    )


def write_archives(df: DataFrame, folder: str, key: str, url: str, payload: str,
                   least: int = 0) -> DataFrame:
    """Write a record per row into archives below ``folder``; returns the list of files.

    The list (``file``, ``records``, ``payload_bytes``) is stored, and only files in it count:
    a task that is run again writes files of new names, and those of the failed run are not
    listed. Null payloads are empty, a null URL leaves its header out, and an empty table
    writes no file. Needs a folder that all executors share and that Arrow can reach.
    """
    kept = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(payload).alias("_p"))
    rows = with_revisits(kept, "_key", F.col("_p"), least).drop("_p")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file: _File | None = None
        done: list[_File] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist()
                       for c in ("_key", "_url", "_revisit", "_refers_to")]
            payloads = batch.column("_payload")
            for i, (k, u, revisit, first) in enumerate(zip(*columns, strict=True)):
                data = payloads[i].as_py()
                if file is None:
                    file = _File(folder)
                    done.append(file)
                file.add(record_bytes(k, u, data, record_id(first) if revisit else None), len(data))
                if file.payload_bytes >= FILE_BYTES:
                    file.close()
                    file = None
        if file is not None:
            file.close()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f.name for f in done], type=pa.string()),
                pa.array([f.records for f in done], type=pa.int64()),
                pa.array([f.payload_bytes for f in done], type=pa.int64()),
            ],
            ["file", "records", "payload_bytes"],
        )

    return materialize(
        rows.mapInArrow(write, "file string, records long, payload_bytes long"), "archives"
    )


# -- reading -------------------------------------------------------------------------------


class Frames:
    """The frames of an archive, one at a time, with the place where each begins."""

    def __init__(self, stream: io.RawIOBase) -> None:
        self.stream, self.held, self.place, self.ended = stream, b"", 0, False
        self.dictionary: zstandard.ZstdCompressionDict | None = None

    def _fill(self, wanted: int) -> bool:
        """Have at least ``wanted`` bytes; False at the end of the file."""
        while len(self.held) < wanted and not self.ended:
            more = self.stream.read(max(READ_BYTES, wanted - len(self.held)))
            if not more:
                self.ended = True
            self.held += more
        return len(self.held) >= wanted

    def _drop(self, size: int) -> None:
        self.held, self.place = self.held[size:], self.place + size

    def __iter__(self) -> Iterator[tuple[int, bytes | None, str]]:
        """Place, content and error of each frame; a broken frame ends the file."""
        first = True
        while self._fill(4) or self.held:
            if not self._fill(8):
                yield self.place, None, "file ends inside a frame"
                return
            magic, size = struct.unpack_from("<II", self.held)
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                if not self._fill(8 + size):
                    yield self.place, None, "file ends inside a skippable frame"
                    return
                if first and magic == DICTIONARY_MAGIC:
                    data = self.held[8 : 8 + size]
                    if data[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be packed
                        data = zstandard.ZstdDecompressor().decompress(data)
                    self.dictionary = zstandard.ZstdCompressionDict(data)
                self._drop(8 + size)
            elif magic == FRAME_MAGIC:
                place = self.place
                content, error = self._frame()
                yield place, content, error
                if content is None:
                    return
            else:
                yield self.place, None, "no frame begins here"
                return
            first = False

    def _frame(self) -> tuple[bytes | None, str]:
        options = {} if self.dictionary is None else {"dict_data": self.dictionary}
        opened = zstandard.ZstdDecompressor(**options).decompressobj()
        parts = []
        try:
            while not opened.eof:
                if not self.held and not self._fill(1):
                    return None, "file ends inside a frame"
                piece = self.held
                parts.append(opened.decompress(piece))
                self._drop(len(piece) - len(opened.unused_data))
        except zstandard.ZstdError as error:
            return None, f"frame cannot be read: {error}"
        return b"".join(parts), ""


def parse_record(record: bytes) -> dict:
    """The fields of a record, or ``error`` with what is wrong with it."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        return {"error": "no WARC header"}
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            return {"error": "malformed header line"}
        headers.setdefault(name.lower(), value.strip())
    missing = [n for n in NEEDED if n.lower() not in headers]
    if missing:
        return {"error": f"header {missing[0]} is missing"}
    size = headers["content-length"]
    if not size.isascii() or not size.isdigit():
        return {"error": "Content-Length is no number"}
    if len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        return {"error": "Content-Length does not match the record"}
    block = rest[:-4]
    kind = headers["warc-type"]
    out = {
        "record_type": kind,
        "record_id": headers["warc-record-id"],
        "target_uri": headers.get("warc-target-uri"),
        "refers_to": headers.get("warc-refers-to"),
        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload": block,
    }
    if headers.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            return {"error": "no HTTP header"}
        length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        if kind == "revisit":
            if payload:
                return {"error": "revisit with a payload"}
            if out["refers_to"] is None:
                return {"error": "revisit without WARC-Refers-To"}
            out |= {"payload": None, "payload_bytes": int(length[1]) if length else None}
            return out
        if length and int(length[1]) != len(payload):
            return {"error": "HTTP Content-Length does not match the payload"}
        out["payload"] = payload
    out["payload_bytes"] = len(out["payload"])
    if out["payload_digest"] and out["payload_digest"] != payload_digest(out["payload"]):
        return {"error": "payload does not match its digest"}
    return out


def read_archives(spark: SparkSession, folder: str, files: DataFrame | None = None,
                  payload: bool = True) -> DataFrame:
    """The records of the archives in ``folder``, in file order, without joining anything.

    ``files`` (column ``file``) names the archives to read; without it, all files that end in
    ``.warc.zst``. Each file is streamed by one task, a record at a time. ``error`` is null for
    a valid record; for others it says what is wrong, and the other fields may be null.
    """
    if files is None:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
        files = found.select(F.element_at(F.split("path", "/"), -1).alias("file"))
    names = files.select("file").distinct()
    # a stated number of partitions is not coalesced to one for names of a few bytes
    names = names.repartition(max(1, min(names.count(), MOST_READERS)), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(_uri(folder))
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with system.open_input_stream(f"{path}/{name}") as stream:
                    yield from _rows(name, Frames(stream), payload)

    return names.mapInArrow(read, RECORD_SCHEMA)


def _rows(name: str, frames: Frames, payload: bool) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    held = 0
    for place, content, error in frames:
        found = {"error": error} if content is None else parse_record(content)
        if not payload:
            found["payload"] = None
        rows.append({"file": name, "offset": place, **found})
        held += len(found.get("payload") or b"") + 200
        if held > 4_000_000:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    columns = [pa.array([r.get(n) for r in rows], type=kinds.get(n, pa.string()))
               for n in _RECORD_NAMES]
    return pa.RecordBatch.from_arrays(columns, _RECORD_NAMES)


def key_of(record: Column) -> Column:
    """The number in a record id that :func:`record_id` made; null for a null key."""
    return F.regexp_extract(record, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archive_folder(df: DataFrame) -> str:
    """A new shared folder for archives."""
    return shared_folder(df, "warc")


__all__ = [
    "Frames",
    "archive_folder",
    "key_of",
    "parse_record",
    "payload_digest",
    "read_archives",
    "record_bytes",
    "with_revisits",
    "write_archives",
]
