"""Token-id output: shards of bit-plane or byte-plane blocks, each plane compressed, with a chunk index.

Shard file, all integers little-endian:
  magic ``BPZ1`` | payload: for each block its planes one after another, each zstandard or nothing when all
  bits are 0 | footer (arrays, zstandard) | footer length u64 | magic ``BPZ1``.
Footer arrays: block table u64[n_blocks, 3] (offset, ids, n_planes), plane lengths u32[sum n_planes],
document ids i64[n_docs], validity u8[n_docs], document lengths u64[n_docs].

Rows keep ascending doc_id order (nulls first), those of equal doc_ids the order of their texts' bytes (null first).
Null or empty texts give the end id alone. Extra columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.llm.common import settle, shared_dir
from fabrichealth.llm.tokens import encoder, read_tokenizer

MAGIC = b"BPZ1"
BLOCK_IDS = 65_536


def to_planes(ids, mode: str) -> list[bytes]:
    """Transpose ids (uint32) into bit planes, or byte planes, lowest first; planes above the highest set are left out."""
    import numpy as np

    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if mode == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range((top + 7) // 8)]
    return [np.packbits(np.ascontiguousarray(raw[:, bit // 8]) & np.uint8(1 << bit % 8), bitorder="little").tobytes() for bit in range(top)]


def from_planes(planes: list[bytes], n: int, mode: str):
    """The inverse of ``to_planes``; an empty plane is all zero."""
    import numpy as np

    out = np.zeros((n, 4), np.uint8)
    if mode == "byte":
        for k, plane in enumerate(planes):
            if plane:
                out[:, k] = np.frombuffer(plane, np.uint8)
    else:
        for k in range((len(planes) + 7) // 8):
            column = np.zeros(n, np.uint8)
            for bit, plane in enumerate(planes[8 * k : 8 * k + 8]):
                if plane:
                    column |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << np.uint8(bit)
            out[:, k] = column
    return out.view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard; holds one block of ids and the document index."""

    def __init__(self, sink, mode: str, level: int):
        import zstandard

        self.sink, self.mode = sink, mode
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.n_ids, self.pending, self.held = len(MAGIC), 0, [], 0
        self.blocks, self.lengths, self.doc_ids, self.valid, self.doc_lengths = [], [], [], [], []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.doc_lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= 4 * BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        import numpy as np

        data, step, done = b"".join(self.pending), 4 * BLOCK_IDS, 0
        while len(data) - done >= step or (last and done < len(data)):
            ids = np.frombuffer(data, "<u4", count=min(step, len(data) - done) // 4, offset=done)
            planes = to_planes(ids, self.mode)
            self.blocks.append((self.at, len(ids), len(planes)))
            for plane in planes:
                packed = self.zip.compress(plane) if any(plane) else b""
                self.sink.write(packed)
                self.lengths.append(len(packed))
                self.at += len(packed)
            done += 4 * len(ids)
        self.pending, self.held = [data[done:]], len(data) - done

    def close(self) -> None:
        import numpy as np

        self._flush(True)
        parts = [np.array(self.blocks, "<u8").reshape(-1, 3), np.array(self.lengths, "<u4"), np.array(self.doc_ids, "<i8"), np.array(self.valid, "u1"), np.array(self.doc_lengths, "<u8")]
        head = np.array([len(self.blocks), len(self.lengths), len(self.doc_ids), self.mode == "bit"], "<u8").tobytes()
        footer = self.zip.compress(head + b"".join(p.tobytes() for p in parts))
        self.sink.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.sink.close()


def read_shard(source):
    """Yield (doc_id, ids as bytes) from a shard, holding one block and one document at a time."""
    import numpy as np
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    size = source.size()
    source.seek(size - 12)
    tail = source.read(12)
    if tail[8:] != MAGIC:
        raise ValueError("not a shard")
    n = int.from_bytes(tail[:8], "little")
    source.seek(size - 12 - n)
    footer = unzip.decompress(source.read(n))
    n_blocks, n_planes, n_docs, bit = np.frombuffer(footer, "<u8", 4)
    at, arrays = 32, []
    for kind, count in (("<u8", 3 * n_blocks), ("<u4", n_planes), ("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs)):
        arrays.append(np.frombuffer(footer, kind, int(count), at))
        at += arrays[-1].nbytes
    blocks, lengths, doc_ids, valid, doc_lengths = arrays

    def ids():
        k = 0
        for offset, count, planes in blocks.reshape(-1, 3).tolist():
            source.seek(offset)
            parts = []
            for length in lengths[k : k + planes].tolist():
                parts.append(unzip.decompress(source.read(length)) if length else b"")
            k += planes
            yield from_planes(parts, count, "bit" if bit else "byte").tobytes()

    stream, rest, pos = ids(), b"", 0
    for doc_id, ok, length in zip(doc_ids.tolist(), valid.tolist(), doc_lengths.tolist()):
        need = 4 * length
        if len(rest) - pos >= need:
            out = rest[pos : pos + need]
            pos += need
        else:
            parts, have = [rest[pos:]], len(rest) - pos
            while have < need:
                rest = next(stream)
                parts.append(rest)
                have += len(rest)
            out = b"".join(parts)
            pos = len(rest) - (have - need)
            out = out[:need]
        yield (doc_id if ok else None), out


def open_store(uri: str):
    """The file system of a folder name and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_ids(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, mode: str = "bit", level: int = 3, folder: str | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shards; returns the manifest (shard, path, n_docs, n_ids).

    Documents are dealt by ranges of doc_id, so shards follow each other in order and each task streams its
    range through one block of memory. A task that is run again writes another file name; the manifest names
    the file of the attempt that was committed.
    """
    spark = docs.sparkSession
    model = read_tokenizer(spark, tokenizer_path)
    base = folder or shared_dir(spark, "ids")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context, encode, end = TaskContext.get(), encoder(model), end_id.to_bytes(4, "little")
        writer, path = None, f"{base}/shard-{context.partitionId():06d}-{context.taskAttemptId()}.bpz"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store, name = open_store(path)
                store.create_dir(name.rpartition("/")[0], recursive=True)
                writer = ShardWriter(store.open_output_stream(name), mode, level)
            texts = batch.column("text").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for at in range(0, len(ids), 500):
                for doc_id, found in zip(ids[at : at + 500], encode.encode_many(texts[at : at + 500])):
                    writer.add(doc_id, found + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": context.partitionId(), "path": path, "n_docs": len(writer.doc_ids), "n_ids": writer.n_ids}])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return settle(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and the ids."""
    return _read(manifest, True)


def read_digests(manifest: DataFrame) -> DataFrame:
    """As ``read_ids`` without the ids themselves."""
    return _read(manifest, False)


def _read(manifest: DataFrame, with_ids: bool) -> DataFrame:
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                store, name = open_store(row["path"])
                start, rows = row["base"], []
                with store.open_input_file(name) as source:
                    for doc_id, ids in read_shard(source):
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), *([ids] if with_ids else [])))
                        start += len(ids) // 4
                        if len(rows) >= 2000:
                            yield _batch(pa, rows, with_ids)
                            rows = []
                if rows:
                    yield _batch(pa, rows, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return placed.select("path", "base").repartition(max(1, manifest.count()), "path").mapInArrow(read, schema)


def _batch(pa, rows, with_ids):
    kinds = [pa.int64()] * 4 + ([pa.binary()] if with_ids else [])
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return read_digests(write_ids(docs))
