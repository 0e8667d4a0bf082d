"""WARC archives compressed with Zstandard: writing, and reading back with checks.

An archive begins with a skippable frame that holds the dictionary; every record
is a frame of its own. Every attempt of a task writes archives under names of its
own, and the table of archives lists those of the attempts that count; readers
take exactly these, or all of a folder that others have written. They find each
frame's end from its block headers, and check the version line, the lengths, the
end of the record and the digest of every payload that is there.

Equal payloads are found without moving any: each chunk of pages asks shards of
digests, whose number follows the input, which row is the first of a payload. A
payload costs a shard one entry for each chunk, however many rows hold it.

Null payloads are empty. Of rows with equal payloads that with the smallest key
(nulls last, then the first read) is a response and the others revisit it. Keys
are integers (others raise an error). A null URL leaves its field out; URLs and
pages may be of any length. An empty table writes nothing and gives an empty
result; other columns are ignored. The dictionary is trained on pages of up to
``SAMPLE_BYTES``; longer ones are written with it like all others.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from dupeplan.llm.common import answered, bound_batches, chunks, file_system, fixed_splits, hashed_sample, materialize, read_replies, scratch_path, shard_count, stamp, write_replies

#: Skippable frame that holds the dictionary, and the magic number of a frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Rows from which a dictionary is trained, bytes of the dictionary, and bytes after which a new archive begins.
SAMPLE, DICTIONARY_BYTES, ARCHIVE_BYTES = 400, 32 << 10, 32 << 20
#: Bytes of the longest page that the dictionary is trained on.
SAMPLE_BYTES = 1 << 17
#: Bytes of a look-up's entry: digest, key and mark.
ENTRY = 29
REQUEST = "shard int, task int, seq int, stamp long, digests binary, keys binary, none binary"
REPLY = "task int, seq int, shard int, stamp long, keys binary, none binary, own binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for the samples; empty if there are too few of them."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def record(kind: str, key: int | None, url: str | None, payload: bytes, date: str, digest: str, refers: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = lambda k: uuid.uuid5(uuid.NAMESPACE_URL, f"{k}:{digest}")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name(key)}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c >= " " else f"%{ord(c):02X}" for c in url)))
    if key is not None:
        fields.append(("Page-ID", str(key)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{name(refers)}>")]
        if refers is not None:
            fields.append(("Refers-To-Page-ID", str(refers)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends."""
    if len(data) < at + 6:
        raise ValueError("a frame is cut off")
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if magic != FRAME_MAGIC:
        raise ValueError(f"no frame begins at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    place = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if len(data) < place + 3:
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[place : place + 3], "little")
        place += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    place += 4 * (flags >> 2 & 1)
    if place > len(data):
        raise ValueError("a frame is cut off")
    return place


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of an archive; ValueError if something is wrong with it."""
    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        at = frame_end(data, 0)
        raw = bytes(data[8:at])
        if len(raw) >= 4 and struct.unpack_from("<I", raw)[0] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        end = frame_end(data, at)
        if struct.unpack_from("<I", data, at)[0] == FRAME_MAGIC:
            yield parse_record(decompressor.decompressobj().decompress(data[at:end]))
        at = end


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not mark or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("a record has no version line")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header line has no colon")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("a record's length is not the one it gives")
    if missing := {"warc-type", "warc-record-id", "warc-date"} - set(fields):
        raise ValueError(f"a record lacks {', '.join(sorted(missing))}")
    return fields, rest[:-4]


def described(fields: dict[str, str], block: bytes) -> dict:
    """What a record says of its page, checked against the payload if it is there."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    lengths = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not mark or len(lengths) != 1 or not lengths[0].isdigit():
        raise ValueError("a record's HTTP header gives no length")
    digest, kind = fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (int(lengths[0]) != len(payload) or payload_digest(payload) != digest):
        raise ValueError("a payload is not the one that its record describes")
    if kind == "revisit" and payload:
        raise ValueError("a revisit has a payload")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"key": number("page-id"), "url": fields.get("warc-target-uri"), "payload_bytes": int(lengths[0]), "payload_digest": digest, "record_type": kind, "refers_to": number("refers-to-page-id"), "payload": payload if kind == "response" else None}


class Payloads:
    """Digests of a chunk's payloads, and the first row of each distinct one, in the order of asking."""

    def __init__(self, table: pa.Table, least: int, shards: int):
        self.payloads = [x.encode() for x in table.column("html").to_pylist()]
        self.digests = [hashlib.sha1(x).digest() for x in self.payloads]
        self.keys = table.column("key").to_pylist()
        first: dict[bytes, tuple[bool, int, int]] = {}
        for i, (k, d, x) in enumerate(zip(self.keys, self.digests, self.payloads, strict=True)):
            if len(x) >= least:
                place = (k is None, k or 0, i)
                if d not in first or place < first[d]:
                    first[d] = place
        shard = {d: int.from_bytes(d[:4], "big") * shards >> 32 for d in first}
        self.first = dict(sorted(first.items()))  # shards ascend with digests
        self.shard = np.array([shard[d] for d in self.first], np.int64)

    def requests(self, task: int, seq: int, mark: int) -> list[dict]:
        digests = list(self.first)
        keys, none = np.array([k for _, k, _ in self.first.values()], np.int64), np.array([n for n, _, _ in self.first.values()], bool)
        edges = [*np.flatnonzero(np.diff(self.shard, prepend=-1)).tolist(), len(digests)]
        return [{"shard": int(self.shard[a]), "task": task, "seq": seq, "stamp": mark, "digests": b"".join(digests[a:b]), "keys": keys[a:b].tobytes(), "none": none[a:b].tobytes()} for a, b in zip(edges, edges[1:])]

    def kinds(self, replies: list[dict]) -> list[tuple[str, int | None]]:
        """(kind, key of the response) of every row."""
        keys = np.frombuffer(b"".join(r["keys"] for r in replies), np.int64).tolist()
        none, own = (np.frombuffer(b"".join(r[c] for r in replies), bool).tolist() for c in ("none", "own"))
        if len(keys) != len(self.first):
            raise RuntimeError("a chunk of pages has changed between two passes; read the pages from a stored table")
        found = {d: (k if not n else None, place[2] if o else -1) for (d, place), k, n, o in zip(self.first.items(), keys, none, own, strict=True)}
        out = []
        for i, d in enumerate(self.digests):
            refers, response = found.get(d, (None, i))
            out.append(("response", None) if response == i else ("revisit", refers))
        return out


def _firsts(table: pa.Table) -> pa.Table:
    """One shard: the first row of every payload, and whether it is the one that a chunk asked for."""
    table = table.sort_by([("task", "ascending"), ("seq", "ascending")])
    digests = np.frombuffer(b"".join(table.column("digests").to_pylist()), "V20")
    keys, none = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64), np.frombuffer(b"".join(table.column("none").to_pylist()), bool)
    parts = digests.view([("a", ">u8"), ("b", ">u8"), ("c", ">u4")])
    by = np.lexsort((keys, none, parts["c"], parts["b"], parts["a"]))  # stable: ties in the order of reading
    starts = np.flatnonzero(np.concatenate([[True], digests[by][1:] != digests[by][:-1]]))
    first = np.empty(len(keys), np.int64)
    first[by] = np.repeat(by[starts], np.diff(np.append(starts, len(by))))
    ends = np.cumsum([len(x) // 20 for x in table.column("digests").to_pylist()])
    out = table.select(["task", "seq", "shard", "stamp"])
    for name, values in (("keys", keys[first]), ("none", none[first]), ("own", first == np.arange(len(first)))):
        out = out.append_column(name, pa.array([x.tobytes() for x in np.split(values, ends[:-1])], pa.binary()))
    return out


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; a table of them (archive, task, number, n_records, n_bytes). ``pages`` must be a stored table."""
    if not isinstance(pages.schema[key].dataType, IntegralType):
        raise ValueError(f"keys must be integers: {key}")
    spark = pages.sparkSession
    bound_batches(spark)
    fixed_splits(spark)
    plain = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    total = plain.count()
    shards = shard_count(spark, ENTRY * total)
    fitting = plain.select("key", "html").where(F.octet_length("html").between(1, SAMPLE_BYTES))
    sampled = hashed_sample(fitting, F.col("key"), SAMPLE).select("html")
    dictionary = train_dictionary([r[0].encode() for r in sampled.collect()])
    request = pa.schema([("shard", pa.int32()), ("task", pa.int32()), ("seq", pa.int32()), ("stamp", pa.int64()), ("digests", pa.binary()), ("keys", pa.binary()), ("none", pa.binary())])

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for seq, table in chunks(batches, "html"):
            yield from pa.Table.from_pylist(Payloads(table, least, shards).requests(task, seq, stamp(table, "key", "html")), request).to_batches()

    replies = write_replies(answered(plain.select("key", "html").mapInArrow(asks, REQUEST), F.col("shard"), shards, _firsts, REPLY), "payloads", ENTRY * total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        found = read_replies(replies, task, ["stamp", "keys", "none", "own"])
        out, n, number = io.BytesIO(lead), 0, 0
        out.seek(0, 2)

        def close() -> pa.RecordBatch:
            name = f"part-{task:06d}-{number:05d}-{attempt}.warc.zst"
            with system.open_output_stream(f"{place}/{name}", compression=None) as f:  # its name would have it compressed again
                f.write(out.getbuffer())
            return pa.RecordBatch.from_pylist([{"archive": name, "task": task, "number": number, "n_records": n, "n_bytes": out.getbuffer().nbytes}], schema)

        for seq, table in chunks(batches, "html"):
            own = Payloads(table, least, shards)
            kinds = own.kinds(found.of(seq, stamp(table, "key", "html")))
            for (kind, refers), payload, digest, page, address in zip(kinds, own.payloads, own.digests, own.keys, table.column("url").to_pylist(), strict=True):
                out.write(compressor.compress(record(kind, page, address, payload, date, base64.b32encode(digest).decode(), refers)))
                n += 1
                if out.tell() >= archive_bytes:
                    yield close()
                    out, n, number = io.BytesIO(lead), 0, number + 1
                    out.seek(0, 2)
        if n:
            yield close()

    schema = pa.schema([("archive", pa.string()), ("task", pa.int32()), ("number", pa.int32()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
    return materialize(plain.select("key", "html", "url").mapInArrow(run, "archive string, task int, number int, n_records long, n_bytes long"), "archives")


def read_archives(spark: SparkSession, folder: str, payloads: bool = False, archives: DataFrame | None = None) -> DataFrame:
    """Per record: key, url, payload_bytes, payload_digest, record_type, refers_to, and with ``payloads`` the payload of responses.

    ``archives`` is the table that ``write_archives`` returns: only what it lists is read. Without it all archives of the folder are.
    """
    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)

    def rows_of(path: str, content: pa.Buffer) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        try:
            for fields, block in read_archive(content):
                found = described(fields, block)
                rows.append({k: found[k] for k in names})
                size += len(block) if payloads else 0
                if len(rows) >= 5000 or size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        except ValueError as error:
            raise ValueError(f"{path}: {error}") from error
        yield pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from rows_of(path, content.as_buffer())

    def run_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{place}/{name}") as f:
                    yield from rows_of(name, f.read_buffer())

    bound_batches(spark)
    ddl = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    if archives is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
        return files.select("path", "content").mapInArrow(run, ddl)
    n = archives.count()
    parts = max(1, min(n, 4 * spark.sparkContext.defaultParallelism), n // 16)
    dealt = archives.select("archive", "task", "number").repartitionById(parts, F.pmod(F.col("task") + 7919 * F.col("number"), F.lit(parts)))
    return dealt.select("archive").mapInArrow(run_listed, ddl)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes all rows to archives in the scratch folder and reads these back. ``pages`` must be a stored table."""
    folder = scratch_path(pages.sparkSession, "warc")
    written = write_archives(pages, folder, key, url, html, least)
    return read_archives(pages.sparkSession, folder, archives=written).withColumnRenamed("key", key)
