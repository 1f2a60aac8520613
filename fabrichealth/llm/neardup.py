"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct 5-word shingles (the whole word sequence when it is shorter). Equal sets
are one representative. Every representative walks independent trees: at a node each of its ``minwise``
tokens is chosen with probability 1 / (similarity * minwise), and the document goes down to the child named
by that token. Documents of a small node are compared exhaustively. Those of a large node are compared to its
first document. Where that leaves at most ``small_node`` documents outside the node's largest cluster, these are
compared with all of the node; where it leaves more, the node is branched again, and one that does so down to
``max_depth`` is taken whole as a candidate cluster. There are so many trees that a
pair just at the similarity is met with ``recall`` even if its nodes stay large to the last level; pairs that
part earlier, or are more similar, are met with more.

Candidate pairs only form clusters. Full sets are then intersected exactly: each document of a cluster with
the cluster's first and with those of its block, then all that are not yet linked to the first with the whole
cluster, block by block. So a group of near copies takes work in proportion to its size, and no link between
different groups is lost.

No texts or words: linked with nothing, component_id is the doc_id itself. Null doc_id: returned with null
component_id and kept null, never linked. Repeated rows of one doc_id: a row each, all of one component; the
sets of all of them count. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabrichealth.llm.common import settle, small_batches
from fabrichealth.llm.components import components


@dataclass(frozen=True)
class Join:
    """``percent``: links have 100 * intersection >= percent * union."""

    percent: int = 85
    words: int = 5
    minwise: int = 64
    recall: float = 0.95
    depth: int = 3
    max_depth: int = 10
    small_node: int = 256
    block: int = 512
    seed: int = 20_240_601

    @property
    def trees(self) -> int:
        """A pair at the similarity shares a chosen token with 1 / minwise, so a node has one shared child on average."""
        met = 1.0
        for _ in range(self.max_depth):
            met = 1 - (1 - met / self.minwise) ** self.minwise
        return math.ceil(math.log(1 - self.recall) / math.log(1 - met))


_word_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]):
    """64-bit hashes of words, remembered by the task (at most 400,000 of them)."""
    import numpy as np
    import xxhash

    if len(_word_hashes) > 400_000:
        _word_hashes.clear()
    known = _word_hashes
    try:
        return np.array([known[w] for w in words], np.uint64)
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)


def mix(x):
    """A 64-bit finalizer on numpy arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, n: int):
    """The sorted distinct shingle hashes of a text."""
    import numpy as np

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    width = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def signature(found, tokens: int, seed: int):
    """The minimum of each of ``tokens`` hash functions over a set, as 32-bit numbers."""
    import numpy as np

    draw = np.random.default_rng(seed)
    a, b = draw.integers(1, 2**63, tokens, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, tokens, np.uint64)
    low = np.full(tokens, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 4096):
            np.minimum(low, (a[:, None] * found[None, at : at + 4096] + b[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, n_shingles, a fingerprint of the set (two longs) and its signature."""

    def sketch(batches):
        import pyarrow as pa
        import xxhash

        _word_hashes.clear()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = shingles(text, join.words)
                print_ = xxhash.xxh3_128_digest(found.tobytes())
                rows.append((doc_id, len(found), int.from_bytes(print_[:8], "little", signed=True), int.from_bytes(print_[8:], "little", signed=True), signature(found, join.minwise, join.seed).tobytes() if len(found) else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n_shingles", "p1", "p2", "sig"])
        _word_hashes.clear()  # the worker goes on to other stages

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(sketch, "doc_id long, n_shingles long, p1 long, p2 long, sig binary")


def children(nodes, sigs, join: Join):
    """Rows of (index, child) for nodes (uint64) and signatures: each token is chosen by a hash of node and place."""
    import numpy as np

    with np.errstate(over="ignore"):
        places = mix(np.arange(1, join.minwise + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        chosen = mix(nodes[:, None] ^ places[None, :])
        at, place = np.nonzero(chosen < np.uint64(min(2**64 - 1, int(2**64 * 100 / (join.percent * join.minwise)))))
        return at, mix(nodes[at] * np.uint64(0x9E3779B97F4A7C15) + places[place] * np.uint64(31) + sigs[at, place])


def branch(rows: DataFrame, join: Join, levels: int, roots: bool) -> DataFrame:
    """Walk down ``levels``: ``rows`` has id, sig and, unless ``roots``, node and group; returns node, id and, unless ``roots``, group."""

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        with np.errstate(over="ignore"):
            tops = mix(np.arange(1, join.trees + 1, dtype=np.uint64) + np.uint64(join.seed))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1).astype(np.uint64)
                if roots:
                    nodes, own = np.tile(tops, len(ids)), np.repeat(np.arange(len(ids)), join.trees)
                else:
                    nodes, own = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64), np.arange(len(ids))
                for _ in range(levels):
                    at_, nodes = children(nodes, sigs[own], join)
                    own = own[at_]
                out = [pa.array(nodes.view(np.int64)), pa.array(ids[own])]
                if not roots:
                    out.append(batch.column("group").take(pa.array(own)))
                yield pa.RecordBatch.from_arrays(out, ["node", "id", "group"][: len(out)])

    return rows.mapInArrow(walk, "node long, id long" + ("" if roots else ", group long"))


def _link_schema():
    import pyarrow as pa

    return pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(ids, linked):
    """(id, smallest id of its group) for the groups of a square matrix of links."""
    import numpy as np

    todo, out = set(range(len(ids))), []
    while todo:
        first = todo.pop()
        edge, group = [first], [first]
        while edge:
            near = [k for k in np.nonzero(linked[edge.pop()])[0].tolist() if k in todo]
            todo.difference_update(near)
            edge += near
            group += near
        if len(group) > 1:
            low = min(ids[k] for k in group)
            out += [(ids[k], low) for k in group if ids[k] != low]
    return out


def _least(join: Join) -> float:
    """Signatures are close when their share of equal tokens is within four standard errors of the similarity."""
    share = join.percent / 100
    return share - 4 * (share * (1 - share) / join.minwise) ** 0.5


def small_nodes(rows: DataFrame, join: Join) -> DataFrame:
    """Candidate links of nodes of at most ``small_node`` documents, compared exhaustively by their signatures.

    Of each node's candidates a spanning forest is enough, since clusters are compared again in full.
    """
    least = _least(join)

    def compare(ids, nodes, sigs):
        import numpy as np

        out = []
        starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
        sizes = np.diff(np.r_[starts, len(nodes)])
        few = np.repeat(sizes <= 8, sizes)
        for step in range(1, 8):
            one = np.flatnonzero(few[:-step] & (nodes[:-step] == nodes[step:]))
            one = one[(sigs[one] == sigs[one + step]).mean(axis=1) >= least]
            out.append(np.stack([ids[one], ids[one + step]]))
        for at, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
            part = sigs[at : at + n]
            close = (part[:, None, :] == part[None, :, :]).mean(axis=2) >= least
            out.append(np.array(_forest(ids[at : at + n].tolist(), close), np.int64).reshape(-1, 2).T)
        return np.concatenate(out, axis=1)

    def runs(batches):
        """Whole nodes of each batch; the last, which may go on in the next batch, is carried over."""
        import numpy as np
        import pyarrow as pa

        rest = None
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
            if not len(ids):
                continue
            if rest is not None:
                nodes, ids, sigs = np.r_[rest[0], nodes], np.r_[rest[1], ids], np.concatenate([rest[2], sigs])
            cut = np.searchsorted(nodes, nodes[-1])
            rest = nodes[cut:], ids[cut:], sigs[cut:]
            if cut:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, compare(ids[:cut], nodes[:cut], sigs[:cut]))), ["a", "b"])
        if rest is not None:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, compare(rest[1], rest[0], rest[2]))), ["a", "b"])

    return rows.select("node", "id", "sig").repartition("node").sortWithinPartitions("node").mapInArrow(runs, "a long, b long")


def pivot_links(rows: DataFrame, reps: DataFrame, join: Join) -> DataFrame:
    """Candidate links of large nodes' documents to the node's first one; ``rows`` has id and low.

    Near copies meet the same first document in many nodes: each such pair is compared once.
    """
    least = _least(join)

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sigs, first = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for n in ("sig", "first"))
            close = (sigs == first).mean(axis=1) >= least if batch.num_rows else np.empty(0, bool)
            yield batch.select(["id", "low"]).rename_columns(["a", "b"]).filter(pa.array(close))

    pairs = rows.select("id", "low").filter("id <> low").distinct()
    first = reps.select(F.col("id").alias("low"), F.col("sig").alias("first"))
    return pairs.join(reps, "id").join(first, "low").select("id", "low", "sig", "first").mapInArrow(compare, "a long, b long")


def main_links(rows: DataFrame, reps: DataFrame, join: Join) -> DataFrame:
    """Candidate links of the documents outside a large node's largest group to one of that group each.

    ``rows`` has node, id, group, main (the largest group) and n; a node has at most ``small_node`` documents
    outside. These meet the group in parts of about ``block`` documents, so the work grows with the group's size.
    """
    least = _least(join)

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, parts, ids, inside = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("node", "part", "id", "inside"))
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
            starts = np.flatnonzero(np.r_[True, (nodes[1:] != nodes[:-1]) | (parts[1:] != parts[:-1])])
            found = []
            for low, high in zip(starts, [*starts[1:], len(ids)]):
                if key != (nodes[low], parts[low]):
                    key, left, left_sigs = (nodes[low], parts[low]), ids[:0], sigs[:0]
                cut = low + np.count_nonzero(~inside[low:high])  # those outside come first
                left, left_sigs = np.r_[left, ids[low:cut]], np.concatenate([left_sigs, sigs[low:cut]])
                for at in range(cut, high, 256):
                    close = (sigs[at : min(at + 256, high), None, :] == left_sigs[None, :, :]).mean(axis=2) >= least
                    met = close.any(axis=0)
                    found.append(np.stack([left[met], ids[at + close.argmax(axis=0)[met]]]))
                    left, left_sigs = left[~met], left_sigs[~met]  # the group is one cluster, so one link is enough
            if found:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(found, axis=1))), ["a", "b"])

    inside, parts = F.col("group") == F.col("main"), F.ceil(F.col("n") / join.block).cast("int")
    own = F.array(F.pmod(F.xxhash64("id"), parts).cast("int"))
    dealt = rows.select("node", "id", inside.alias("inside"), F.explode(F.when(inside, own).otherwise(F.sequence(F.lit(0), parts - 1))).alias("part"))
    return dealt.join(reps, "id").select("node", "part", "inside", "id", "sig").repartition("node", "part").sortWithinPartitions("node", "part", "inside").mapInArrow(compare, "a long, b long")


def candidate_clusters(reps: DataFrame, join: Join) -> DataFrame:
    """(id, component): clusters that hold every pair that the trees bring together. ``reps`` has id and sig."""

    def live(nodes: DataFrame) -> DataFrame:
        """Rows of nodes of several documents with the node's size and first document."""
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
        return settle(nodes.join(sizes.filter("low < high").select("node", "n", "low"), "node"), "live")

    def mixed(nodes: DataFrame) -> DataFrame:
        """Rows of nodes of several groups with the node's size, first document, largest group and what is outside it."""
        sizes = nodes.groupBy("node", "group").agg(F.count("*").alias("n"), F.min("id").alias("low"))
        sizes = sizes.groupBy("node").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max(F.struct("n", "group")).alias("top")).filter("top.n < n")
        return settle(nodes.join(sizes.select("node", "n", "low", F.col("top.group").alias("main"), (F.col("n") - F.col("top.n")).alias("outside")), "node"), "mixed")

    small, large = F.col("n") <= join.small_node, F.col("n") > join.small_node
    few = large & (F.col("outside") <= join.small_node)
    rows = live(settle(branch(reps, join, join.depth, True), "nodes"))
    clusters = settle(components(small_nodes(rows.filter(small).join(reps, "id"), join).unionByName(pivot_links(rows.filter(large), reps, join))), "clusters")
    groups = clusters.withColumnRenamed("component", "of")
    # within a cluster all is compared anyway, so only nodes of several clusters go on
    rows = rows.filter(large).join(groups, "id", "left").select("id", "node", F.coalesce("of", "id").alias("group"))
    more = []
    for depth in range(join.depth, join.max_depth + 1):
        if rows.isEmpty():
            break
        if depth > join.depth:
            rows = settle(branch(rows.select("id", "node", "group").join(reps, "id"), join, 1, False), "nodes")
        rows = mixed(rows)
        more.append(small_nodes(rows.filter(small | few & (F.col("group") != F.col("main"))).join(reps, "id"), join))
        more.append(main_links(rows.filter(few), reps, join))
        rows = rows.filter(large & ~few)
    else:
        more.append(rows.select(F.col("id").alias("a"), F.col("low").alias("b")))
    links = clusters.select(F.col("id").alias("a"), F.col("component").alias("b"))
    for found in more:
        links = links.unionByName(found)
    return settle(components(links), "clusters") if more else clusters


def exact_links(docs: DataFrame, clusters: DataFrame, join: Join) -> DataFrame:
    """(a, b) of ``clusters(id, component)``: links by full sets, enough of them to give the same components as all.

    A cluster is cut into blocks of about ``block`` documents. Each block is compared in itself and with the
    cluster's first document. Those not linked to the first, directly or over others, are cut into blocks of
    their own, and each is compared with every block of the cluster, each pair of blocks in a task of its own.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    texts = settle(texts.join(clusters.select("id"), "id").dropDuplicates(), "texts")

    def with_sets(named: DataFrame) -> DataFrame:
        """Adds the sets of ``named(id, component, ...)``."""

        def sets(batches):
            import pyarrow as pa

            for batch in batches:
                found = [shingles(t, join.words).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "text"), pa.array(found, pa.binary())], [*(n for n in batch.schema.names if n != "text"), "set"])
            _word_hashes.clear()

        return texts.join(named, "id").select(*named.columns, "text").mapInArrow(sets, ", ".join(f"{n} {t}" for n, t in named.dtypes) + ", set binary")

    def compare(key, group):
        import numpy as np
        import pyarrow as pa

        ids = group.column("id").to_pylist()
        found = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
        sizes = np.array([len(s) for s in found])
        tokens, code, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(ids)), sizes)
        shared = times[code] > 1
        code, owner = code[shared], owner[shared]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        _, code = np.unique(code, return_inverse=True)
        inter = np.zeros((len(ids), len(ids)), np.float32)
        for at in range(0, int(code.max()) + 1 if len(code) else 0, 4096):
            low, high = np.searchsorted(code, (at, at + 4096))
            block = np.zeros((len(ids), 4096), np.float32)
            block[owner[low:high], code[low:high] - at] = 1
            inter += block @ block.T
        inter = np.rint(inter).astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - inter
        linked = _forest(ids, 100 * inter >= join.percent * union)
        return pa.table({"a": [a for a, _ in linked], "b": [b for _, b in linked]}, schema=_link_schema())

    def blocks_of(rows: DataFrame, count: str, at: str) -> DataFrame:
        sizes = rows.groupBy("component").agg(F.ceil(F.count("*") / join.block).cast("int").alias(count))
        return rows.join(sizes, "component").withColumn(at, F.pmod(F.xxhash64("id"), F.col(count)).cast("int"))

    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    cut = settle(blocks_of(clusters, "blocks", "block"), "blocks")
    once = with_sets(cut).withColumn("block", F.explode(F.when(F.col("id") == F.col("component"), every("blocks")).otherwise(F.array("block"))))
    near = settle(components(once.groupBy("component", "block").applyInArrow(compare, "a long, b long")), "near")
    links = near.select(F.col("id").alias("a"), F.col("component").alias("b"))
    # a cluster's first document has its smallest id, so what is linked to it has that component
    apart = cut.filter("blocks > 1").join(near.withColumnRenamed("component", "of"), "id", "left").filter(F.coalesce("of", "id") != F.col("component")).drop("of")
    apart = settle(blocks_of(apart, "others", "other"), "apart")
    if apart.isEmpty():
        return links
    others = apart.select("component", "others").distinct()
    left = with_sets(apart).withColumn("block", F.explode(every("blocks"))).select("component", "other", "block", "id", "set")
    right = with_sets(cut.join(others, "component")).withColumn("other", F.explode(every("others"))).select("component", "other", "block", "id", "set")
    return links.unionByName(left.unionByName(right).groupBy("component", "other", "block").applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of ``docs(doc_id, text)``."""
    small_batches(docs.sparkSession)
    sketched = settle(sketches(docs, join), "sketches")
    known = sketched.filter("n_shingles > 0 and doc_id is not null")
    prints = known.groupBy("p1", "p2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = settle(known.join(prints.select(F.col("rep").alias("doc_id"), "p1", "p2"), ["doc_id", "p1", "p2"], "left_semi").select(F.col("doc_id").alias("id"), "sig").distinct(), "reps")
    # the texts of one doc_id are one document: it links the groups that they fall in
    repeated = known.groupBy("doc_id").agg(F.min("p1").alias("x"), F.max("p1").alias("y")).filter("x < y").select("doc_id")
    same = known.join(repeated, "doc_id", "left_semi").join(prints, ["p1", "p2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked = settle(components(exact_links(docs, candidate_clusters(reps, join), join).unionByName(same)), "linked")
    rep_of = prints.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("p1", "p2", F.coalesce("component", "rep").alias("component_id"))
    out = sketched.join(rep_of, ["p1", "p2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The rows of ``docs`` without those that have a smaller doc_id in their component; null doc_ids stay."""
    gone = settle(near_duplicates(docs, join).filter("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
