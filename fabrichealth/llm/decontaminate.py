"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit check.

Texts are sequences of words (lower-cased, letters and digits only; words without any are dropped). An item
is found in a document where some stretch is within ``edit_share`` of the item's words in edit distance.

The CGK embedding walks along a sequence: each step copies the current word and moves on or stays by a random
bit of step and word, so sequences at a small edit distance get embeddings at a small Hamming distance. A
repetition samples ``samples`` places of the embedding; windows of documents and items that agree there are
candidates. Items are taken in classes that double in length; a class of shortest length m has windows of
about 3/4 m words, of ``window`` words at most, since a long window holds too many edits to agree. Every
window of an item is kept, and one in s of a document, with s so small that each unedited occurrence holds an
aligned window, and ``stride`` at most, so that long items have several. Repetitions follow from the target
recall, which is held at ``edit_share`` for every length of item (measured with edits of all kinds at random
places: 0.95 or more of items of 5 to 250 words). Every candidate is verified by the exact edit distance of
the whole item to the document around the match.

Items of fewer than ``min_words`` words leave no room for an edit: they are found where their words stand as they are,
by the hash of all their words. Null or empty texts and items match nothing. Repeated rows are
searched one by one; null ids are kept as null. Extra columns are passed through by ``clean``. The items are
collected in blocks of about ``block_chars`` characters, and each block is searched in turn.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Search:
    edit_share: float = 0.2
    samples: int = 4
    recall: float = 0.95
    agreement: float = 0.7
    window: int = 12
    stride: int = 6
    min_words: int = 5
    block_chars: int = 16_000_000
    seed: int = 7

    @property
    def repetitions(self) -> int:
        """So many that a window whose embedding agrees in ``agreement`` of its places is met with ``recall``."""
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.agreement**self.samples))


_words: dict[bytes, int] = {}
_other = re.compile(r"[\W_]+")


def _learn(word: bytes) -> int:
    import xxhash

    if len(_words) > 400_000:
        _words.clear()
    kept = _other.sub("", word.decode("utf-8", "replace").lower())
    found = _words[word] = (xxhash.xxh3_64_intdigest(kept) | 1) if kept else 0
    return found


def word_codes(text: bytes | None):
    """64-bit codes of a text's words."""
    import numpy as np

    words = (text or b"").split()
    try:
        codes = np.array(list(map(_words.__getitem__, words)), np.uint64)
    except KeyError:
        codes = np.array([_words[w] if w in _words else _learn(w) for w in words], np.uint64)
    return codes[codes != 0]


def run_hashes(codes, n: int):
    """A hash of the ``n`` words from each place on."""
    import numpy as np

    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def edit_distance(item, region) -> tuple[int, int]:
    """The least edit distance of ``item`` to any stretch of ``region``, and the first place where one ends."""
    import numpy as np

    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for k, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """The sampled embeddings of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], search: Search):
        import numpy as np

        self.search = search
        self.items = [(i, c) for i, t in items if len(c := word_codes(t)) > 0]
        self.words = [frozenset(c.tolist()) for _, c in self.items]
        self.classes = []
        by_length = sorted(range(len(self.items)), key=lambda k: len(self.items[k][1]))
        self.short: dict[int, dict[int, list[int]]] = {}  # by number of words: the items of each hash
        while by_length and len(self.items[by_length[0]][1]) < search.min_words:
            k = by_length.pop(0)
            n = len(self.items[k][1])
            self.short.setdefault(n, {}).setdefault(int(run_hashes(self.items[k][1], n)[0]), []).append(k)
        draw = np.random.default_rng(search.seed)
        while by_length:
            least = len(self.items[by_length[0]][1])
            members = [k for k in by_length if len(self.items[k][1]) < 2 * least or least >= 2 * search.window]
            by_length = by_length[len(members) :]
            width = max(1, min(3 * least // 4, search.window))
            text = np.concatenate([self.items[k][1] for k in members])
            starts, owner, offset, at = [], [], [], 0
            for k in members:
                n = len(self.items[k][1]) - width + 1
                starts.append(np.arange(at, at + n))
                owner += [k] * n
                offset += range(n)
                at += len(self.items[k][1])
            starts, repetitions = np.concatenate(starts), []
            for _ in range(search.repetitions):
                odd = draw.integers(0, 2**63, 2 * width, np.uint64) * np.uint64(2) + np.uint64(1)
                rest = 1 + draw.choice(2 * width - 1, min(search.samples - 1, 2 * width - 1), replace=False)
                places = sorted({int(draw.integers(0, min(4, 2 * width))), *rest.tolist()})
                _, keys = walk(text, starts, width, odd, places, None)
                order = np.argsort(keys[-1], kind="stable")
                repetitions.append((odd, places, [np.unique(k) for k in keys[:-1]], keys[-1][order], order))
            self.classes.append((width, min(least - width + 1, search.stride), np.array(owner), np.array(offset), repetitions))

    def matches(self, texts: list[bytes | None]) -> list[tuple[int, int | None, int, int]]:
        """(index of the text, item_id, distance, first word): the closest match of each text and item."""
        import numpy as np

        codes = [word_codes(t) for t in texts]
        lengths = np.array([len(c) for c in codes], np.int64)
        ends = np.cumsum(lengths)
        whole = np.concatenate([*codes, np.empty(0, np.uint64)])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried = set()
        for n, items in self.short.items():
            hashes = run_hashes(whole, n)
            for start in np.flatnonzero(np.isin(hashes, np.array(list(items), np.uint64))).tolist():
                text = int(np.searchsorted(ends, start, "right"))
                at = start - int(ends[text] - lengths[text])
                for k in items[int(hashes[start])]:
                    if at + n <= lengths[text] and (text, k) not in best and (codes[text][at : at + n] == self.items[k][1]).all():
                        best[text, k] = (0, at)
        for width, stride, owner, offset, repetitions in self.classes:
            counts = np.maximum(0, (lengths - width) // stride + 1) * (lengths >= width)
            first = np.repeat(ends - lengths, counts)
            number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = first + stride * number
            for odd, places, partial, last, order in repetitions:
                alive, keys = walk(whole, starts, width, odd, places, [*partial, last])
                low, high = np.searchsorted(last, keys[-1]), np.searchsorted(last, keys[-1], "right")
                for start, a, b in zip(starts[alive].tolist(), low.tolist(), high.tolist()):
                    text = int(np.searchsorted(ends, start, "right"))
                    for w in order[a:b].tolist():
                        k = int(owner[w])
                        at = start - int(offset[w]) - int(ends[text] - lengths[text])
                        if (text, k, at) not in tried:
                            tried.add((text, k, at))
                            self._verify(best, text, k, at, codes[text])
        return [(text, self.items[k][0], d, at) for (text, k), (d, at) in best.items()]

    def _verify(self, best, text, k, at, codes) -> None:
        item = self.items[k][1]
        allowed = int(self.search.edit_share * len(item))
        if (found := best.get((text, k))) and found[0] == 0:
            return
        begin = max(0, at - allowed)
        if at >= 0 and len(codes) >= at + len(item) and (codes[at : at + len(item)] == item).all():
            distance, place = 0, at
        else:
            region = codes[begin : max(0, at + len(item) + allowed)]
            if len(self.words[k].difference(region.tolist())) > allowed:
                return  # each of the item's words that is missing takes an edit of its own
            distance, end = edit_distance(item, region)
            place = max(0, begin + end - len(item))
        if distance <= allowed and (found is None or (distance, place) < found):
            best[text, k] = (distance, place)


def walk(text, starts, width, odd, places, wanted):
    """Walk windows up to the last sampled place; returns the windows left and their keys after each place.

    With ``wanted`` (sorted keys after each place) a window is given up once its key is not among them, which
    loses no agreement.
    """
    import numpy as np

    alive, at = np.arange(len(starts)), starts.astype(np.int64)
    limit, key, keys, place = at + width, np.zeros(len(starts), np.uint64), [], 0
    with np.errstate(over="ignore"):
        for step in range(places[-1] + 1):
            inside = at < limit
            word = np.where(inside, text[np.minimum(at, len(text) - 1)], np.uint64(0)) if len(text) else np.zeros(len(at), np.uint64)
            if step == places[place]:
                key = (key ^ word) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1)
                key ^= key >> np.uint64(31)
                if wanted is not None:
                    known = wanted[place]
                    if len(known):
                        good = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                    else:
                        good = np.zeros(len(key), bool)
                    alive, at, limit, key, word = alive[good], at[good], limit[good], key[good], word[good]
                keys.append(key)
                place += 1
            at = at + ((word * odd[step]) >> np.uint64(63)).astype(np.int64)
    return alive, keys


def _indexes(benchmark: DataFrame, search: Search):
    """Broadcast blocks of items, of about ``block_chars`` characters each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / search.block_chars))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in part.collect()])


_built: dict = {}


def _index(block, search: Search) -> Index:
    key = (id(block.value), search)
    if key not in _built:
        _built.clear()
        _built[key] = (block.value, Index(block.value, search))
    return _built[key][1]


SLICE = 400


def find(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """doc_id, item_id, distance, first_word: the closest match of every document and item."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = None
    for block in _indexes(benchmark, search):

        def scan(batches, block=block):
            import pyarrow as pa

            index = _index(block, search)
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    ids = batch.column("doc_id").to_pylist()
                    rows = [(ids[t], i, d, p) for t, i, d, p in index.matches(batch.column("text").to_pylist())]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "item_id", "distance", "first_word"])

        found = texts.mapInArrow(scan, "doc_id long, item_id long, distance int, first_word long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; nothing is shuffled."""
    for block in _indexes(benchmark, search):

        def scan(batches, block=block):
            import numpy as np
            import pyarrow as pa

            index = _index(block, search)
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    texts = [t.encode() if isinstance(t, str) else t for t in batch.column("text").to_pylist()]
                    keep = np.ones(batch.num_rows, bool)
                    keep[[t for t, *_ in index.matches(texts)]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
