"""Deleted-interpolation language model: counts of all training documents, weights by EM on a held-out part.

Every training word is a symbol, and one more stands for all words that training never saw. A symbol's
probability mixes the maximum-likelihood estimates of bigram, unigram and the uniform distribution; the
weights depend on the power of two of the context's count, and are learned by expectation-maximisation on the
bigram counts of a deleted part of the training documents, against estimates from the rest.

Texts are read once, into slices of about ``slice_tokens`` tokens: whole documents as codes of the slice's own
dictionary. A slice counts its distinct words and bigrams and sends them, dealt by hash in compressed blocks,
to be added up; each block is answered with the counts in the whole corpus, in the order in which they were
asked for. So a word or bigram that is frequent everywhere is one entry a slice, no key gathers more than
that, and no count is cut off or kept on the driver. The answered slices give the weights and then the scores.

Words and bigrams are told apart by 64-bit hashes. Null or empty text: the end token alone. Null doc_id: its
crc32 is that of an empty text. Repeated rows count and are scored one by one. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabrichealth.llm.common import settle
from fabrichealth.llm.neardup import mix

END = b"\n"  # never a word
START = 1  # stands for the hash of what precedes a document's first word
MOST_WORDS = 400_000  # that a worker remembers before it starts over
PIECE_BYTES = 4_000_000  # of a long text that are split into words at once
BUCKETS = 48  # powers of two of a context's count


@dataclass(frozen=True)
class Model:
    deleted: int = 8
    slice_tokens: int = 1_000_000
    key_tokens: int = 2_000_000
    rounds: int = 12


class Codes:
    """Words to small numbers within a worker, with their hashes."""

    def __init__(self):
        import numpy as np

        self.known, self.hashes = {}, np.empty(0, np.uint64)

    def encode(self, words: list[bytes]):
        import numpy as np
        import xxhash

        try:
            return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        except KeyError:
            new = [w for w in set(words) if w not in self.known]
            for k, w in enumerate(new, len(self.known)):
                self.known[w] = k
            self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new))])
            return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))


def pieces(text: bytes):
    """Lower-cased words of a text, some millions of bytes at a time, cut between words."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        end = max(text.rfind(space, at + 1, at + PIECE_BYTES) for space in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        end = at + PIECE_BYTES if end < 0 else end
        while end < len(text) and text[end] not in b" \n\t\r\x0b\x0c":  # one word longer than a piece
            end += 1
        yield text[at:end].lower().split()
        at = end
    yield text[at:].lower().split()


def _pack(*arrays) -> bytes:
    """Arrays of numbers as byte planes, compressed."""
    import numpy as np
    import zstandard

    head = len(arrays).to_bytes(4, "little") + b"".join(len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(8) for a in arrays)
    planes = (np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpack(blob: bytes):
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, out = int.from_bytes(raw[:4], "little"), []
    at = 4 + 16 * n
    for k in range(n):
        head = raw[4 + 16 * k : 20 + 16 * k]
        size, kind = int.from_bytes(head[:8], "little"), np.dtype(head[8:].decode().strip())
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += size * kind.itemsize
    return out


def _small(x):
    """Numbers of 0 and more in the narrowest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype("u1" if top < 2**8 else "u2" if top < 2**16 else "u4" if top < 2**32 else "u8")


def _gaps(x):
    import numpy as np

    return np.diff(x, prepend=x[:1] * 0)


def slices(docs: DataFrame, model: Model) -> DataFrame:
    """(slice, tokens, n, d, blob): whole documents in codes of a dictionary, and their tokens, of training and deleted."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number, codes = TaskContext.get().partitionId() << 32, Codes()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def made(number, rows, parts):
            ids, role, lengths = np.concatenate(parts), np.array([r[1] for r in rows], "u1"), np.array([r[2] for r in rows])
            times = np.bincount(ids, minlength=len(codes.known))
            used = np.flatnonzero(times)
            used = used[np.argsort(-times[used], kind="stable")]  # frequent words get small codes
            place = np.zeros(len(codes.known), np.int32)
            place[used] = np.arange(len(used))
            doc_ids = np.array([r[0] or 0 for r in rows], "i8")
            blob = _pack(doc_ids, np.array([r[0] is not None for r in rows], "u1"), role, _small(lengths), codes.hashes[used], _small(place[ids]))
            row = (number, len(ids), int(lengths[role < 2].sum()), int(lengths[role == 1].sum()), blob)
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], ["slice", "tokens", "n", "d", "blob"])

        rows, parts, size, words = [], [], 0, []
        for batch in batches:
            for doc_id, role, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "role", "text"))):
                begun = size
                for own in pieces(text or b""):
                    words += own
                    size += len(own)
                    if len(words) > 250_000:
                        parts.append(codes.encode(words))
                        words = []
                words.append(END)
                size += 1
                rows.append((doc_id, role, size - begun))
                if size >= model.slice_tokens:
                    yield made(number, rows, [*parts, codes.encode(words)])
                    number, rows, parts, size, words = number + 1, [], [], 0, []
                    if len(codes.known) > MOST_WORDS:
                        codes = Codes()
        if rows:
            yield made(number, rows, [*parts, codes.encode(words)])

    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    role = F.when(part % 7 == 2, 2).when(F.floor(part / 7) % model.deleted == 0, 1).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), role.cast("int").alias("role"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "slice long, tokens long, n long, d long, blob binary")


class Slice:
    """The tokens of a slice: each one's document, code and the code before; ``len(hashes)`` is that of the start."""

    def __init__(self, blob: bytes):
        import numpy as np

        self.doc_ids, self.valid, self.role, self.lengths, self.hashes, codes = _unpack(blob)
        self.code = codes.astype(np.int64)
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.before = np.r_[0, self.code[:-1]]
        self.before[np.r_[True, self.row[1:] != self.row[:-1]]] = len(self.hashes)

    def distinct(self):
        """Of words and then of bigrams: a token of each in order of the hashes, the hashes, and the counts of training and deleted tokens."""
        import numpy as np

        names = np.r_[self.hashes, np.uint64(START)]
        with np.errstate(over="ignore"):
            pair = mix(names[self.before] * np.uint64(0x9E3779B97F4A7C15) + names[self.code])
        role = self.role[self.row]
        for keys in (self.hashes[self.code], pair):
            order = np.argsort(keys)
            keys, own = keys[order], role[order]
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            yield order, start, keys[start], *(np.add.reduceat(use.astype(np.int64), start) for use in (own < 2, own == 1))


def _bucket_of(hashes, buckets: int):
    import numpy as np

    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def ask(sliced: DataFrame, buckets: int) -> DataFrame:
    """(bucket, slice, blob): the hashes of a slice's words and bigrams with their counts there."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist()):
                parts = [(keys, _bucket_of(keys, buckets), n, d) for _, _, keys, n, d in Slice(blob).distinct()]
                rows = []
                for bucket in np.unique(np.concatenate([p[1] for p in parts])).tolist():
                    arrays = []
                    for keys, dealt, n, d in parts:
                        own = slice(*np.searchsorted(dealt, (bucket, bucket + 1)))
                        arrays += [_gaps(keys[own]), _small(n[own]), _small(d[own])]
                    rows.append((bucket, number, _pack(*arrays)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "slice", "blob"])

    return sliced.select("slice", "blob").mapInArrow(run, "bucket int, slice long, blob binary")


def answer(asked: DataFrame, buckets: int) -> DataFrame:
    """(slice, bucket, vocabulary, blob): the counts in the corpus, in the order of what was asked; a row without slice has the distinct training words."""

    def one(bucket, rows):
        import numpy as np
        import pyarrow as pa

        parts, sums, vocabulary = [_unpack(blob) for _, blob in rows], [], 0
        for k in (0, 3):  # words, then bigrams
            keys, back = np.unique(np.concatenate([np.cumsum(p[k], dtype=np.uint64) for p in parts]), return_inverse=True)
            sums += [np.bincount(back, np.concatenate([p[k + i] for p in parts]), len(keys)).astype(np.int64)[back] if len(back) else back for i in (1, 2)]
            if k == 0:
                vocabulary = int((np.bincount(back, sums[0]) > 0).sum()) if len(back) else 0
        out, at = [(None, bucket, vocabulary, None)], [0, 0]
        for (number, _), p in zip(rows, parts):
            end = [at[0] + len(p[0]), at[1] + len(p[3])]
            out.append((number, bucket, 0, _pack(*(_small(x[at[i // 2] : end[i // 2]]) for i, x in enumerate(sums)))))
            at = end
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["slice", "bucket", "vocabulary", "blob"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for bucket, number, blob in zip(*(batch.column(n).to_pylist() for n in ("bucket", "slice", "blob"))):
                if bucket != now and rows:
                    yield one(now, rows)
                    rows = []
                now = bucket
                rows.append((number, blob))
        if rows:
            yield one(now, rows)

    dealt = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "slice long, bucket int, vocabulary long, blob binary")


def counted(sliced: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """kind 0: a slice's documents and codes with the corpus counts of its words and bigrams; kind 1: of its deleted
    bigrams the counts of context, bigram and word in the rest of the training documents, and their own."""

    def one(blobs):
        import numpy as np

        own = Slice(blobs[0])
        (_, first, keys, *_), (order, start, pairs, _, here) = own.distinct()
        found = [np.concatenate(p).astype(np.int64) for p in zip(*map(_unpack, blobs[1:]))]
        assert len(found[0]) == len(keys) and len(found[2]) == len(pairs)
        words = np.zeros((2, len(own.hashes) + 1), np.int64)
        words[:, np.argsort(own.hashes)] = found[:2]
        # the start is as frequent as the end, which precedes nothing
        end = int(own.code[-1])
        context = words.copy()
        context[:, -1] = words[:, end]
        key = own.before[order[start]] * len(own.hashes) + own.code[order[start]]
        kept = found[2][np.argsort(key)]
        yield 0, _pack(own.doc_ids, own.valid, own.role, _small(own.lengths), _small(own.code), _small(words[0, :-1]), _small(kept))
        use = np.flatnonzero(here)
        if len(use):
            token = order[start[use]]
            c, w = (x[0] - x[1] for x in (context[:, own.before[token]], words[:, own.code[token]]))
            yield 1, _pack(*map(_small, (c, (found[2] - found[3])[use], w, here[use])))

    def run(batches):
        import pyarrow as pa

        def made(blobs):
            rows = list(one(blobs))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary()))], ["kind", "blob"])

        now, blobs = None, []
        for batch in batches:
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist()):
                if number != now and blobs:
                    yield made(blobs)
                    blobs = []
                now = number
                blobs.append(blob)
        if blobs:
            yield made(blobs)

    both = sliced.select("slice", F.lit(-1).alias("bucket"), "blob").unionByName(answers.filter("slice is not null").select("slice", "bucket", "blob"))
    return both.repartition(parts, "slice").sortWithinPartitions("slice", "bucket").mapInArrow(run, "kind int, blob binary")


def _bucket(count):
    import numpy as np

    return np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0)


def estimates(context, n, symbol, total):
    """Context bucket and the bigram and unigram estimates from the counts of context, bigram and symbol."""
    import numpy as np

    return _bucket(context), np.where(context > 0, n / np.maximum(context, 1), 0.0), symbol / max(total, 1)


def learn_weights(deleted: DataFrame, total: int, symbols: int, model: Model):
    """EM: the weights (bucket, 3) that make the deleted part's bigrams likeliest; the driver sees sums per bucket."""
    import numpy as np

    spark = deleted.sparkSession
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 1 / 2, 1 / 2  # a context without counts has no bigram estimate
    uniform = 1 / symbols

    def expected(weights, context, n, symbol, d):
        bucket, p2, p1 = estimates(context, n, symbol, total)
        parts = weights[bucket] * np.stack([p2, p1, np.full(len(p1), uniform)], axis=1)
        parts *= (d / np.maximum(parts.sum(axis=1), 1e-300))[:, None]
        return np.stack([np.bincount(bucket, weights=parts[:, k], minlength=BUCKETS) for k in range(3)], axis=1)

    for _ in range(model.rounds):
        now = spark.sparkContext.broadcast(weights)

        def run(batches, now=now):
            import pyarrow as pa

            out = np.zeros((BUCKETS, 3))
            for batch in batches:
                for blob in batch.column("blob").to_pylist():
                    out += expected(now.value, *(x.astype(np.int64) for x in _unpack(blob)))
            yield pa.RecordBatch.from_pylist([{"bucket": b, "e2": float(x[0]), "e1": float(x[1]), "e0": float(x[2])} for b, x in enumerate(out)])

        sums = np.zeros((BUCKETS, 3))
        for r in deleted.mapInArrow(run, "bucket long, e2 double, e1 double, e0 double").groupBy("bucket").agg(F.sum("e2").alias("e2"), F.sum("e1").alias("e1"), F.sum("e0").alias("e0")).collect():
            sums[r["bucket"]] += (r["e2"], r["e1"], r["e0"])
        # one pseudo-count keeps buckets without evidence at the mean of the others, and every weight above 0
        mean = (sums.sum(axis=0) + 1e-3) / (sums.sum() + 3e-3)
        new = (sums + mean) / (sums.sum(axis=1, keepdims=True) + 1)
        new[0, 0] = 0
        new[0] /= new[0].sum()
        moved, weights = np.abs(new - weights).max(), new
        if moved < 1e-3:
            break
    return weights


def mixed(weights, context, n, symbol, total, symbols: int):
    """log10 of the interpolated probability."""
    import numpy as np

    bucket, p2, p1 = estimates(context, n, symbol, total)
    w = weights[bucket]
    return np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / symbols)


def scored(slices_: DataFrame, weights, total: int, vocabulary: int) -> DataFrame:
    known = slices_.sparkSession.sparkContext.broadcast(weights)

    def one(blob):
        import numpy as np
        import pyarrow as pa

        doc_ids, valid, role, lengths, code, words, pairs = _unpack(blob)
        code, words, size = code.astype(np.int64), words.astype(np.int64), len(words)
        row = np.repeat(np.arange(len(lengths)), lengths)
        before = np.r_[0, code[:-1]]
        before[np.r_[True, row[1:] != row[:-1]]] = size
        key, back = np.unique(before * size + code, return_inverse=True)
        context = np.r_[words, words[code[-1]]]
        logs = mixed(known.value, context[key // size], pairs.astype(np.int64), words[key % size], total, vocabulary + 1)
        of_rows = lambda x: np.bincount(row, weights=x, minlength=len(lengths))
        lengths = lengths.astype(np.int64)
        columns = {
            "doc_id": pa.array(doc_ids, mask=valid == 0),
            "held_out": pa.array(role == 2),
            "n_tokens": pa.array(lengths),
            "n_known": pa.array(of_rows(words[code] > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(lengths), total, np.int64)),
            "base_score": pa.array(of_rows(np.log10(words + 1.0)[code]) - lengths * math.log10(total + vocabulary + 1)),
            "score": pa.array(of_rows(logs[back])),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches):
        for batch in batches:
            yield from map(one, batch.column("blob").to_pylist())

    return slices_.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, model: Model = Model()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs(doc_id, text)``."""
    sliced = settle(slices(docs, model), "slices")
    parts, tokens, total, deleted = sliced.agg(F.count("*"), F.sum("tokens"), F.sum("n"), F.sum("d")).first()
    total, deleted = total or 0, deleted or 0
    buckets = max(32, math.ceil((tokens or 0) / model.key_tokens))
    answers = settle(answer(ask(sliced, buckets), buckets), "answers")
    vocabulary = answers.agg(F.sum("vocabulary")).first()[0] or 0
    found = settle(counted(sliced, answers, max(1, parts)), "counted", "kind")
    weights = learn_weights(found.filter("kind = 1").select("blob"), total - deleted, vocabulary + 1, model)
    return scored(found.filter("kind = 0").select("blob"), weights, total, vocabulary)
