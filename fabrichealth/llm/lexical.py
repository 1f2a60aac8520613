"""Ranked lexical search: every document is ranked for each item of a query set with a document FP-tree.

Terms are runs of ASCII letters, digits and characters above ASCII, A-Z lower-cased. One pass over the texts
restricts each document to the items' terms: a vector of (term, tf) and its length. The counts of the corpus
(N, L, df) come from those vectors. A task sorts its vectors by their terms in order of document frequency,
most frequent first, so documents that begin alike share the path of a trie. A node stands for the documents
of its subtree: the maxima of tf and the minimum of m in it bound the score of each of them for an item, as a
score grows with tf and falls with m. The walk is depth-first; an item leaves a subtree as soon as its bound there
is below the item's last place so far. Tasks give their best ``k`` for each item, which meet in two steps.

Items are taken in blocks of ``BLOCK_BYTES`` of text by a hash of their id; a block's terms are broadcast, so what is
sent is bounded, and the documents are read once for each block (one block up to 16 MB of items).

Null or empty texts have no terms: they count in no statistic and match nothing. Null or empty items match
nothing. Equal rows (item_id, text) of items are one item; rows that share an item_id with other texts are items
of their own, each with its own ranks. Repeated rows of documents are documents of their own. Equal scores go by
ascending doc_id, null ids last. Extra columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.llm.common import UPPER, settle

#: Bytes of item text whose terms are broadcast together.
BLOCK_BYTES = 16_000_000
#: Documents and vector entries of one trie, and the documents below which a node is scored as a whole.
TRIE_DOCS, TRIE_ENTRIES, LEAF_DOCS = 4096, 1_000_000, 32

RESULT = "item_no int, doc_id long, score long"


def _alphabet() -> bytes:
    """A byte table: letters and digits stay, A-Z become lower case, bytes above ASCII stay, all others part terms."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


ALPHABET = _alphabet()


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALPHABET).split()


def weight(documents: int, df: int) -> int:
    """A term's whole-number weight."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs of ``docs(doc_id, text)``, restricted to a broadcast {term: number}."""

    def restrict(batches):
        import pyarrow as pa

        number = vocabulary.value.get
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                found = Counter(map(number, words))
                found.pop(None, None)
                lengths.append(len(words))
                terms.append(list(found))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(restrict, "doc_id long, n long, terms array<int>, tfs array<int>")


class Trie:
    """The FP-tree of a batch of vectors: sorted rows, of which a node is a range with a common beginning.

    ``rows`` are (terms in order, tfs, m, doc_ids): equal vectors are one row with its ``k`` smallest ids.
    """

    def __init__(self, rows: list[tuple]):
        import numpy as np

        self.rows = rows
        sizes = [len(r[0]) for r in rows]
        self.at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.terms = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int32)
        self.tfs = np.concatenate([r[1] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.m = np.array([r[2] for r in rows], np.int64)
        self.shared = np.zeros(len(rows), np.int64)  # terms that a row's path shares with the row before it
        for i in range(1, len(rows)):
            a, b = rows[i - 1][0], rows[i][0]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.shared[i] = differ[0] if len(differ) else n

    def children(self, low: int, high: int) -> list[tuple[int, int]]:
        """The ranges below a node: its rows parted where the common path is shortest."""
        import numpy as np

        inner = self.shared[low + 1 : high]
        cuts = [low, *(low + 1 + np.flatnonzero(inner == inner.min())).tolist(), high]
        return list(zip(cuts, cuts[1:]))


class Ranking:
    """The best ``k`` documents of each item, and the walk that fills them."""

    def __init__(self, item_terms: list[list[int]], weights: list[int], k: int):
        import numpy as np

        self.k, self.items = k, len(item_terms)
        self.weights = np.array(weights, np.int64)
        pairs = sorted((t, i) for i, terms in enumerate(item_terms) for t in set(terms))
        self.holders = np.array([i for _, i in pairs], np.int64)  # the items of each term, one after another
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(weights) + 1))
        self.found: list[list[tuple]] = [[] for _ in item_terms]
        self.least = np.ones(self.items, np.int64)  # a score below this can't enter any more
        self.visited = self.skipped = 0

    def gains(self, terms, tfs, m):
        """What an entry adds to the score of each item that holds its term."""
        return self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))

    def sums(self, rows, n_rows: int, terms, gains):
        """A row of scores per document or node: gains added up for each item that holds the term."""
        import numpy as np

        many = self.first[terms + 1] - self.first[terms]
        ends = np.cumsum(many)
        entry = np.repeat(np.arange(len(terms)), many)
        items = self.holders[np.arange(len(entry)) - (ends - many)[entry] + self.first[terms][entry]]
        flat = np.bincount(rows[entry] * self.items + items, weights=gains[entry].astype(np.float64), minlength=n_rows * self.items)
        return flat.astype(np.int64).reshape(n_rows, self.items)  # whole numbers far below 2 ** 53, so exact

    def bound(self, trie: Trie, low: int, high: int):
        """An upper bound of each item's score in a node: the subtree's tf maxima under its smallest m."""
        import numpy as np

        part = slice(trie.at[low], trie.at[high])
        terms, tfs = trie.terms[part], trie.tfs[part]
        most = np.zeros(len(self.weights), np.int64)
        np.maximum.at(most, terms, tfs)
        terms = np.flatnonzero(most)
        return self.sums(np.zeros(len(terms), np.int64), 1, terms, self.gains(terms, most[terms], int(trie.m[low:high].min())))[0]

    def walk(self, trie: Trie) -> None:
        """Depth-first over the trie; below a node only the items go on whose bound there reaches their last place."""
        import numpy as np

        if not trie.rows:
            return
        stack = [(0, len(trie.rows), np.arange(self.items))]
        while stack:
            low, high, active = stack.pop()
            active = active[self.bound(trie, low, high)[active] >= self.least[active]]
            if not len(active):
                self.skipped += high - low
            elif high - low <= LEAF_DOCS:
                self.score(trie, low, high, active)
            else:
                stack.extend((a, b, active) for a, b in reversed(trie.children(low, high)))

    def score(self, trie: Trie, low: int, high: int, active) -> None:
        import numpy as np

        self.visited += high - low
        part = slice(trie.at[low], trie.at[high])
        rows = np.repeat(np.arange(high - low), np.diff(trie.at[low : high + 1]))
        terms, tfs = trie.terms[part], trie.tfs[part]
        scores = self.sums(rows, high - low, terms, self.gains(terms, tfs, trie.m[low:high][rows]))
        for row, i in zip(*(x.tolist() for x in np.nonzero(scores[:, active] >= self.least[active]))):
            item = int(active[i])
            score = int(scores[row, item])
            self.found[item].extend((-score, d is None, d or 0, d) for d in trie.rows[low + row][3])
            if len(self.found[item]) >= 4 * self.k:
                self.cut(item)

    def cut(self, item: int) -> None:
        best = self.found[item] = sorted(self.found[item])[: self.k]
        if len(best) == self.k:
            self.least[item] = -best[-1][0]

    def results(self):
        for item in range(self.items):
            self.cut(item)
            for negative, _, _, doc_id in self.found[item]:
                yield item, doc_id, -negative


def sorted_rows(batch: list[tuple], k: int) -> list[tuple]:
    """(terms, tfs, m, doc_id) to a trie's rows: sorted by their terms, equal vectors joined with their ``k`` smallest ids."""
    joined: dict[tuple, list] = {}
    for terms, tfs, m, doc_id in batch:
        joined.setdefault((terms.astype(">u4").tobytes(), tfs.tobytes(), m), [terms, tfs, m, []])[3].append(doc_id)
    return [(t, f, m, sorted(ids, key=lambda d: (d is None, d or 0))[:k]) for _, (t, f, m, ids) in sorted(joined.items(), key=lambda x: x[0])]


def best_in_tasks(vectors: DataFrame, model, k: int) -> DataFrame:
    """The best ``k`` documents of each item among those of a task: item_no, doc_id, score."""

    def rank(batches):
        import numpy as np
        import pyarrow as pa

        item_terms, order, weights, documents, length = model.value
        order = np.array(order, np.int32)
        ranking, batch, entries = Ranking(item_terms, weights, k), [], 0
        for found in batches:
            ids, lengths = found.column("doc_id").to_pylist(), found.column("n").to_pylist()
            at, terms, tfs = (x.to_numpy(zero_copy_only=False) for x in (found.column("terms").offsets, found.column("terms").values, found.column("tfs").values))
            for i, (doc_id, n) in enumerate(zip(ids, lengths)):
                own = order[terms[at[i] : at[i + 1]]]
                by = np.argsort(own)
                batch.append((own[by], tfs[at[i] : at[i + 1]][by], 50 + (50 * n * documents) // length, doc_id))
                entries += len(own)
                if len(batch) >= TRIE_DOCS or entries >= TRIE_ENTRIES:
                    ranking.walk(Trie(sorted_rows(batch, k)))
                    batch, entries = [], 0
        ranking.walk(Trie(sorted_rows(batch, k)))
        rows = list(ranking.results())
        for start in range(0, len(rows), 50_000):
            items, docs, scores = zip(*rows[start : start + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], ["item_no", "doc_id", "score"])

    return vectors.filter(F.size("terms") > 0).mapInArrow(rank, RESULT)


def rank_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """item_id, rank, doc_id, score for one block of (item_id, text)."""
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    item_terms = [[number.setdefault(t, len(number)) for t in dict.fromkeys(terms_of(text.encode()))] for _, text in items]
    vocabulary = spark.sparkContext.broadcast(number)
    restricted = settle(vectors(docs, vocabulary), "vectors")
    documents, length = restricted.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["df"] for r in restricted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # a row per term of the block
    by_df = sorted(range(len(number)), key=lambda t: (-df.get(t, 0), t))
    order = [0] * len(number)
    for place, t in enumerate(by_df):
        order[t] = place
    weights = [weight(documents, df.get(t, 0)) for t in by_df]
    model = spark.sparkContext.broadcast(([[order[t] for t in terms] for terms in item_terms], order, weights, documents, length))
    best = best_in_tasks(restricted, model, k).withColumn("part", F.spark_partition_id() % 64)
    places = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    for key in (["item_no", "part"], ["item_no"]):
        best = best.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*places))).filter(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item_no int, item_id long")
    return best.join(F.broadcast(ids), "item_no").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of ``docs(doc_id, text)`` for each of ``items(item_id, text)``: item_id, rank, doc_id, score."""
    asked = settle(items.filter(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct(), "items")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    out = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        found = rank_block(docs, [tuple(r) for r in rows], k)
        found = settle(found, "ranked") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


ORACLE = rf"""
with d as (select row_number() over () as row_id, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents where text is not null),
l as (select row_id, doc_id, len(words) as n from d where len(words) > 0),
s as (select count(*) as docs, cast(sum(n) as bigint) as total from l),
t as (select row_id, term, count(*) as tf from (select row_id, unnest(words) as term from d) group by all),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from t, s where term in (select term from i) group by term, docs),
m as (select row_id, doc_id, 50 + ((50 * n * docs) // total) as m from l, s),
x as (select item_id, row_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from i join w using (term) join t using (term) join m using (row_id) group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from x where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 50"""
