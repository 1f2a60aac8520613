"""Best-fit-decreasing packing of token sequences, exact over the whole table.

Lengths are whole numbers up to the sequence size, so best-fit decreasing over all pieces is the same as
best-fit decreasing over the counts of each length: pieces of one length are placed together, run by run, in
the tightest remaining capacity, which a segment tree over capacities finds in logarithmic time. The driver
sees one count for each length and the runs of placements; both depend on the sequence size alone, not on
the number of documents.

Null or empty texts give the end id alone. Repeated rows and equal or null doc_ids are packed row by row.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.llm.common import settle
from fabrichealth.llm.tokens import encoder, read_tokenizer

SEQUENCE = 2048


class CapacityTree:
    """A segment tree over remaining capacities that finds the smallest open one not below a length."""

    def __init__(self, top: int):
        self.width = 1 << top.bit_length()
        self.open = [0] * (2 * self.width)

    def set(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.width
        self.open[at] = int(is_open)
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        at = length + self.width
        if self.open[at]:
            return length
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def best_fit_runs(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Place ``counts[length]`` pieces; returns runs (length, first rank, how many, first sequence, offset)."""
    tree, bins, runs, opened = CapacityTree(size), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                rest = size - length
                runs.append((length, rank, left, opened, 0))
                if rest:
                    bins.setdefault(rest, []).append((opened, left))
                    tree.set(rest, True)
                opened += left
                break
            first, many = bins[room].pop()
            take = min(many, left)
            runs.append((length, rank, take, first, size - room))
            if take < many:
                bins[room].append((first + take, many - take))
            if not bins[room]:
                tree.set(room, False)
            if room - length:
                bins.setdefault(room - length, []).append((first, take))
                tree.set(room - length, True)
            rank, left = rank + take, left - take
    return runs


def cut_pieces(docs: DataFrame, size: int = SEQUENCE, tokenizer_path: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Encode and cut: doc_id, piece, start, length, ids_crc32, and its task and rank among the task's pieces of that length."""
    model = read_tokenizer(docs.sparkSession, tokenizer_path)

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end, task = encoder(model), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"] + ["ids"] * with_ids
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for at in range(0, len(ids), 500):
                rows = []
                for doc_id, found in zip(ids[at : at + 500], encode.encode_many(texts[at : at + 500])):
                    found += end
                    for piece, start in enumerate(range(0, len(found) // 4, size)):
                        part = found[4 * start : 4 * (start + size)]
                        n = len(part) // 4
                        rows.append((doc_id, piece, start, n, zlib.crc32(part), task, seen[n], *([part] if with_ids else [])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, schema)


def place(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to a settled table of pieces.

    A piece's rank among all pieces of its length is its rank in its task plus the counts of earlier tasks;
    one length may hold most rows, since tasks are ranked on their own and only their counts meet.
    """
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    bases = counts.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(best_fit_runs(totals, size))
    model = pieces.sparkSession.sparkContext.broadcast(([r[:2] for r in runs], runs))

    def locate(batches):
        import pyarrow as pa

        keys, placed = model.value
        for batch in batches:
            sequences, offsets = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
                _, first_rank, _, first, offset = placed[bisect.bisect_right(keys, (length, rank)) - 1]
                sequences.append(first + rank - first_rank)
                offsets.append(offset)
            arrays = [batch.column(n) for n in batch.schema.names if n not in ("rank", "task")]
            names = [n for n in batch.schema.names if n not in ("rank", "task")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    ranked = pieces.join(bases.select("length", "task", "base"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    kept = [c for c in pieces.columns if c not in ("rank", "task")]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in kept)
    return ranked.select(*kept, "task", "rank").mapInArrow(locate, f"{out}, sequence_id long, offset long")


def pack(docs: DataFrame, size: int = SEQUENCE, tokenizer_path: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of ``size`` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    pieces = settle(cut_pieces(docs, size, tokenizer_path, end_id, with_ids), "pieces")
    if not with_ids:
        return place(pieces, size)
    # ids are not sent through the placement, but meet their place by the piece's task, length and rank there
    own = {"_task": F.col("task"), "_rank": F.col("rank")}
    placed = place(pieces.drop("ids").withColumns(own), size)
    ids = pieces.withColumns(own).select("_task", "length", "_rank", "ids")
    return placed.join(ids, ["_task", "length", "_rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
