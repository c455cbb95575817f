"""Token ids as sorted-string-table shards.

A shard holds documents in ascending key order: blocks of prefix-compressed entries, each block followed by its CRC-32;
then a sparse index (last key, offset and length of each block), a Bloom filter of the document ids, and a footer of
fixed size. A document is found by the filter, a binary search in the index and a scan of one block.

    entry   varint shared, varint rest, varint size, rest of the key, value
    key     0x01, doc_id + 2**63 as 8 bytes big-endian, 4 bytes big-endian number among rows of the same id
            (0x00 and zeros in place of a null id, which so comes first)
    value   ids as little-endian unsigned integers of `width` bytes, the end id included
    footer  offsets and lengths of index and filter, documents, ids, width, magic

Cases: a null text is an empty one and gives the end id alone; a very long text is one entry, in a block of its own size; rows of one
doc_id stay apart, in order of their texts' hashes, and if many fill several shards their numbers start anew in each; an empty table makes no shard and no row; further columns are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm._bpe import default_tokenizer, loaded
from foliant.llm._common import bound_batches, shared_dir, stash

MAGIC = b"FOLSST01"
FOOTER = struct.Struct("<QQQQQQQ8s")
BITS_PER_KEY, PROBES = 10, 7


def key_of(doc_id: int | None, number: int) -> bytes:
    return (b"\x00" + bytes(8) if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + 2**63)) + struct.pack(">I", number)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - 2**63 if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh128_intdigest(key[:9])
    a, b = h >> 64, h & (2**64 - 1) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes one shard to a stream; it holds one block, the index and 10 bits a document."""

    def __init__(self, sink, width: int, block_bytes: int = 64 * 1024):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.block, self.last, self.index, self.at = bytearray(), b"", [], 0
        self.hashes: list[bytes] = []
        self.n_docs = self.n_ids = 0
        self.first = b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.first, self.last = self.first or key, key
        self.hashes.append(key[:9])
        self.n_docs += 1
        self.n_ids += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.last, self.at, len(data)))
            self.sink.write(data)
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index)
        bits = max(64, BITS_PER_KEY * len(self.hashes))
        bloom = np.zeros(bits // 8 + 1, np.uint8)
        for k in self.hashes:
            for p in probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<Q", bits) + bloom.tobytes()
        self.sink.write(index + bloom)
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n_docs, self.n_ids, self.width, MAGIC))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Shard:
    """Reads one shard: all of it block by block, or one document."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        *parts, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        data, self.index, at = self.file.read_at(parts[1], parts[0]), [], 0
        while at < len(data):
            n, at = read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = read_varint(data, at)
            length, at = read_varint(data, at)
            self.index.append((key, offset, length))
        self.bloom_at = parts[2], parts[3]
        self.bloom: bytes | None = None

    def entries(self, offset: int, length: int) -> Iterator[tuple[bytes, bytes]]:
        data = self.file.read_at(length, offset)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        at, end, key = 0, length - 4, b""
        while at < end:
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + size]
            at += rest + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, offset, length in self.index:
            yield from self.entries(offset, length)

    def may_hold(self, doc_id: int | None) -> bool:
        if self.bloom is None:
            self.bloom = self.file.read_at(self.bloom_at[1], self.bloom_at[0])
        return all(self.bloom[8 + (p >> 3)] >> (p & 7) & 1 for p in probes(key_of(doc_id, 0), struct.unpack("<Q", self.bloom[:8])[0]))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row of this document."""
        found: list[np.ndarray] = []
        if not self.may_hold(doc_id):
            return found
        wanted = key_of(doc_id, 0)
        for last, offset, length in self.index[bisect_left(self.index, wanted, key=lambda x: x[0]) :]:
            found += [np.frombuffer(v, f"<u{self.width}") for k, v in self.entries(offset, length) if k[:9] == wanted[:9]]
            if last[:9] > wanted[:9]:
                break
        return found


MANIFEST = "shard int, path string, n_docs long, n_ids long, first_id long, last_id long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write docs (doc_id, text) as shards into folder, a place that all executors reach; return the manifest.

    A shard is written under another name and then moved, so a repeated task leaves one whole file.
    """
    tokenizer = tokenizer or default_tokenizer()
    bound_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        encoder, fs_path = loaded(tokenizer), filesystem(folder)
        fs, path = fs_path[0], f"{fs_path[1].rstrip('/')}/shard-{number:06d}.sst"
        end = np.array([end_id], encoder.dtype).tobytes()
        writer = sink = None
        part, before, same = f"{path}.{uuid.uuid4().hex}.part", object(), 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            if writer is None and ids:
                fs.create_dir(fs_path[1], recursive=True)
                sink = fs.open_output_stream(part)
                writer = ShardWriter(sink, encoder.dtype.itemsize)
            for doc_id, value in zip(ids, encoder.encode(batch.column("text"))):
                same = same + 1 if doc_id == before else 0
                before = doc_id
                writer.add(key_of(doc_id, same), value + end)
        if writer:
            writer.close()
            sink.close()
            fs.move(part, path)
            row = [[number], [f"{folder.rstrip('/')}/shard-{number:06d}.sst"], [writer.n_docs], [writer.n_ids], [id_of(writer.first)], [id_of(writer.last)]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.string()), *(pa.array(x, pa.int64()) for x in row[2:])], ["shard", "path", "n_docs", "n_ids", "first_id", "last_id"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return stash(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names.

    start counts the ids of all documents before it; the running sum is over one row for each shard.
    """
    order = Window.orderBy("shard")
    starts = manifest.select("path", (F.sum("n_ids").over(order) - F.col("n_ids")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard, rows = Shard(path), []
                for key, value in shard:
                    ids = np.frombuffer(value, f"<u{shard.width}")
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode, write and read back: one row for each document, in the files' order of doc_id."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/foliant/shards-{uuid.uuid4().hex}"
    return read_shards(write_shards(docs, folder, tokenizer, end_id))
