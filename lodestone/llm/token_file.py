"""Token-ID output: fixed-width bit packing with block offsets.

A shard holds the documents of one range of doc_id.  Ids are packed most significant bit first in
``bits`` bits, the fewest that hold the vocabulary, in blocks of ``block`` ids that start on a byte:

    magic "LDTK0001", bits u32, block u32 | blocks | block offsets u64[n_blocks + 1]
    | doc_id i64[n_docs], doc_id known u8[n_docs], first id u64[n_docs + 1] | n_blocks, n_docs, n_ids u64, magic

All numbers are little-endian.  Block b is unpacked alone with numpy, so any id or document is read
without what stands before it.  A shard is written under a name of its own and only then listed in the
manifest, so a task that is run again leaves an unlisted file and never a half-written listed one.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, task, written
from .tokens import encoder, slices

MAGIC = b"LDTK0001"
BLOCK = 1 << 16
_HEAD, _TAIL = 16, 32


def width(vocab_size: int) -> int:
    """Fewest bits that hold ids 0 to vocab_size - 1."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, most significant bit first, padded to whole bytes."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits:].ravel()).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits:] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class Writer:
    """Streams documents into one shard."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        self.store, self.path = fs.FileSystem.from_uri(uri)
        self.uri, self.bits, self.block = uri, bits, block
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(self.path)
        self.out.write(MAGIC + np.array([bits, block], "<u4").tobytes())
        self.offsets, self.rest = [_HEAD], np.zeros(0, np.uint32)
        self.docs, self.known, self.first, self.n = [], [], [np.zeros(1, np.int64)], 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.known.append(doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.first.append(self.n + ends)
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // self.block * self.block
        for a in range(0, full, self.block):
            self._block(ids[a:a + self.block])
        self.rest = ids[full:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> dict:
        if len(self.rest):
            self._block(self.rest)
        docs = np.concatenate([*self.docs, np.zeros(0, "<i8")])
        for part in (np.array(self.offsets, "<u8"), docs, np.concatenate([*self.known, np.zeros(0, np.uint8)]), np.concatenate(self.first).astype("<u8")):
            self.out.write(part.tobytes())
        self.out.write(np.array([len(self.offsets) - 1, len(docs), self.n], "<u8").tobytes() + MAGIC)
        self.out.close()
        return {"path": self.uri, "n_docs": len(docs), "n_ids": self.n}


class Reader:
    """Random access to one shard: ``ids(a, b)`` unpacks only the blocks that hold ids a to b."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        head, tail = self.file.read_at(_HEAD, 0), self.file.read_at(_TAIL, size - _TAIL)
        if head[:8] != MAGIC or tail[-8:] != MAGIC:
            raise ValueError(f"not a whole token shard: {uri}")
        self.bits, self.block = (int(x) for x in np.frombuffer(head, "<u4", 2, 8))
        n_blocks, n_docs, self.n_ids = (int(x) for x in np.frombuffer(tail, "<u8", 3))
        table = self.file.read_at(size, size - _TAIL - 8 * (n_blocks + 1) - 17 * n_docs - 8)
        self.offsets = np.frombuffer(table, "<u8", n_blocks + 1).astype(np.int64)
        at = 8 * (n_blocks + 1)
        self.docs = np.frombuffer(table, "<i8", n_docs, at)
        self.known = np.frombuffer(table, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        self.first = np.frombuffer(table, "<u8", n_docs + 1, at + 9 * n_docs).astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, np.uint32)
        lo, hi = a // self.block, (b - 1) // self.block
        out = [unpack(self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k])), min(self.block, self.n_ids - k * self.block), self.bits) for k in range(lo, hi + 1)]
        return np.concatenate(out)[a - lo * self.block:b - lo * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each document."""
    out = np.insert(ids, ends, end_id) if len(ends) else ids
    return out.astype(np.uint32, copy=False), ends + np.arange(1, len(ends) + 1)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all documents and write them as shards in ascending doc_id; returns the manifest.

    One range shuffle of (doc_id, text); each task streams its range into one shard, holding one batch
    of texts at a time.  Manifest: shard, path, n_docs, n_ids, start (ids in all shards before).
    Null text: no ids but the end id.  Null doc_id: first, kept as null.  Repeated doc_id: each row is a
    document, ties in order of text.  Empty table: empty manifest.  Other columns are not read.
    """
    root = fresh_path(docs.sparkSession, "tokens")

    def run(batches):
        out, shard = None, TaskContext.get().partitionId()
        enc = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "t"):
                out = out or Writer(f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.ldtk", width(enc.vocab_size))
                out.add(part.column("d"), *with_end(*enc.encode(part.column("t")), end_id))
        if out:
            yield pa.RecordBatch.from_pylist([{"shard": shard, **out.close()}], schema)

    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    ordered = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).repartitionByRange("d").sortWithinPartitions("d", "t")
    manifest = written(ordered.mapInArrow(task(run), "shard int, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens, ids_crc32, and ids if asked for."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Reader(row["path"])
                a, n = 0, len(shard.docs)
                while a < n:  # documents whose ids fit about 16 blocks, or one longer document
                    b = max(a + 1, int(np.searchsorted(shard.first, shard.first[a] + 16 * shard.block, "right")) - 1)
                    ids, first = shard.ids(int(shard.first[a]), int(shard.first[b])).astype("<u4"), shard.first[a:b + 1] - shard.first[a]
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(first, first[1:])]
                    cols = [pa.array(shard.docs[a:b], mask=~shard.known[a:b]), pa.array(row["start"] + shard.first[a:b]), pa.array(np.diff(first)), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)
                    a = b

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n).mapInArrow(task(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
