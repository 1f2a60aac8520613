"""Hard-negative mining over embeddings: anchor clusters share one candidate list each, sorted by an angular bound.

Anchors are clustered by direction. For a cluster with centroid c whose members lie within an angle b of it, no
member u scores above |u| |v| cos(max(0, angle(v, c) - b)) with a candidate v. A task sorts its candidates by that
bound once per cluster, and every member walks the list from the top until the bound at its place, times its own
norm, is below what it still needs: from there on nothing can enter, which certifies the result. Two walks are made:
the first finds each anchor's positives, the second, with the positives' scores known, the best negatives in each
score band. Scores are exact whole numbers.

Before the walks, rows of equal label and equal vector become one candidate with their smallest ids, as many as a
result can hold, and anchors of equal label and vector become one query, so large groups of copies are walked once.
Queries are searched in blocks of ``BLOCK_BYTES``, each broadcast to the tasks that hold the candidates: the stated query set
against all rows. The clusters' centroids are fitted on at most ``FIT_ROWS`` queries; every query is assigned.

Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Vectors of another
length than the anchor's are no candidates of it. Where vec_id is divisible by ``relabel``, the label first becomes
(label + 1) % 10. Repeated rows are rows of their own, but those with the anchor's own vec_id are never its positive.
Equal scores go by ascending vec_id. Scores that don't fit 64 bits are refused. Extra columns are ignored; an empty
table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.llm.common import settle

#: Bytes of query vectors that are broadcast together, and the most queries that centroids are fitted on.
BLOCK_BYTES, FIT_ROWS = 32_000_000, 20_000
#: Bytes of candidates whose bounds are sorted together in a task, and places of a list that are scored at a time.
LIST_BYTES, STRIDE = 32_000_000, 512
MEMBERS_PER_CLUSTER, MOST_CLUSTERS = 64, 128


def prepared(embeddings: DataFrame, relabel: int = 7) -> DataFrame:
    """vec_id, label and whole-number vector of the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    rows = rows.filter(F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))))
    moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), F.transform("x", lambda v: F.floor(v * 256)).alias("vector"))


def candidates_of(rows: DataFrame, ids: int) -> DataFrame:
    """label, vector and the ``ids`` smallest vec_ids of each group of equal ones; groups are cut before they meet."""
    near = W.partitionBy("label", "vector").orderBy("vec_id")
    return rows.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= ids).groupBy("label", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def centroids_of(queries: DataFrame, rounds: int = 5) -> list:
    """Directions of the clusters: spherical k-means over a bounded sample of the queries by hash; a zero vector has no direction.

    Any centroids give the same results; good ones only make the walks shorter.
    """
    import numpy as np

    directed = queries.filter(F.exists("vector", lambda v: v != 0))
    shapes = directed.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(1).collect()
    if not shapes:
        return []
    length, many = shapes[0]
    sample = directed.filter(F.size("vector") == length).orderBy(F.xxhash64("q_id"), "q_id").limit(max(1, min(FIT_ROWS, BLOCK_BYTES // (8 * length)))).collect()
    units = np.array([r["vector"] for r in sample], np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    centres = units[: max(1, min(MOST_CLUSTERS, many // MEMBERS_PER_CLUSTER, len(units)))]
    for _ in range(rounds):
        nearest = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return list(centres)


class Cluster:
    """Queries near one centroid: their vectors, and the largest angle between the centroid and one of them."""

    def __init__(self, centroid, members: list[dict]):
        import numpy as np

        self.members = members
        self.vectors = np.array([m["vector"] for m in members], np.int64)
        self.labels = np.array([m["label"] for m in members], np.int64)
        self.norms = _norms(self.vectors)
        self.centroid = np.asarray(centroid, np.float64)
        angles = _angles(self.vectors, self.norms, self.centroid)
        self.spread = float(angles[self.norms > 0].max(initial=0.0)) + 1e-7

    def upper_bounds(self, vectors, norms):
        """What no member can exceed with each candidate, per unit of its norm; a little too much is added for rounding."""
        import numpy as np

        angles = np.maximum(0.0, _angles(vectors, norms, self.centroid) - self.spread)
        return norms * np.cos(angles) + 1e-9 * norms


def _norms(vectors):
    import numpy as np

    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


def _angles(vectors, norms, centroid):
    import numpy as np

    length = math.sqrt(float(centroid @ centroid)) or 1.0
    safe = np.where(norms > 0, norms, 1.0)
    return np.where(norms > 0, np.arccos(np.clip(vectors.astype(np.float64) @ centroid / (safe * length), -1.0, 1.0)), 0.0)


def clusters_of(queries: list[dict], centroids: list) -> list[Cluster]:
    """Every query to the centroid of the smallest angle; those of another length than the centroids' form one cluster per length."""
    import numpy as np

    groups: dict[tuple, list[dict]] = {}
    by_length: dict[int, list[dict]] = {}
    for q in queries:
        by_length.setdefault(len(q["vector"]), []).append(q)
    for length, own in by_length.items():
        if not centroids or len(centroids[0]) != length:
            groups[length, -1] = own
            continue
        nearest = np.argmax(np.array([q["vector"] for q in own], np.float64) @ np.array(centroids).T, axis=1)
        for q, c in zip(own, nearest.tolist()):
            groups.setdefault((length, c), []).append(q)
    return [Cluster(centroids[c] if c >= 0 else members[0]["vector"], members) for (_, c), members in sorted(groups.items())]


def inner_products(a, b):
    """Exact products of two whole-number matrices; floating point is used only where it can't round."""
    import numpy as np

    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    raise ValueError("inner products of these vectors may not fit 64 bits")


class Best:
    """The best ``k`` (score, vec_id) of a query within a score band; ``need`` is what a further score must reach."""

    def __init__(self, k: int, band: int | None = None, low: int | None = None):
        self.k, self.band, self.low, self.found = k, band, low, []
        self.need = -math.inf if low is None else low

    def add(self, scores, ids, at) -> None:
        """Candidates ``at`` with their scores; each has the smallest ids of its copies."""
        import numpy as np

        fits = scores >= self.need if self.band is None else (scores >= self.need) & (scores <= self.band)
        chosen = np.flatnonzero(fits)
        if not len(chosen):
            return
        # at most k candidates, by score and smallest id, can hold the k best ids
        first = np.array([ids[i][0] for i in at[chosen]], np.int64)
        for j in np.lexsort((first, -scores[chosen]))[: self.k].tolist():
            self.found.extend((-int(scores[chosen[j]]), i) for i in ids[at[chosen[j]]])
        self.found = sorted(self.found)[: self.k]
        if len(self.found) == self.k:
            self.need = -self.found[-1][0]


def walk(cluster: Cluster, vectors, labels, ids, bests: list[list[Best]], same_label: bool, count=None) -> None:
    """Members walk the cluster's list of candidates until their bound certifies that nothing is missing."""
    import numpy as np

    norms = _norms(vectors)
    bounds = cluster.upper_bounds(vectors, norms)
    order = np.argsort(-bounds, kind="stable")
    active = [m for m, own in enumerate(bests) if own]
    for start in range(0, len(order), STRIDE):
        ceiling = float(bounds[order[start]])
        active = [m for m in active if cluster.norms[m] * ceiling * (1 + 1e-9) + 1e-6 >= min(b.need for b in bests[m])]
        if not active:
            return
        at = order[start : start + STRIDE]
        scores = inner_products(cluster.vectors[active], vectors[at])
        alike = labels[at][None, :] == cluster.labels[active][:, None]
        fits = alike if same_label else ~alike
        if count is not None:
            count(len(active) * len(at))
        for row, m in enumerate(active):
            own = np.flatnonzero(fits[row] & (scores[row] >= min(b.need for b in bests[m])))
            if len(own):
                for best in bests[m]:
                    best.add(scores[row][own], ids, at[own])


def search_block(candidates: DataFrame, clusters, k: int, same_label: bool) -> DataFrame:
    """The best ``k`` of each query (and band) among the candidates of a task: q_id, band, score, vec_id."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = clusters.value
        bests = [[[Best(k, p, low) for p, low in m["bands"]] if m["bands"] is not None else [Best(k)] for m in c.members] for c in known]

        def search(rows):
            for length in {len(r[0]) for r in rows}:
                own = [r for r in rows if len(r[0]) == length]
                vectors = np.array([r[0] for r in own], np.int64).reshape(len(own), length)
                labels, ids = np.array([r[1] for r in own], np.int64), [r[2] for r in own]
                for cluster, found in zip(known, bests):
                    if cluster.vectors.shape[1] == length:
                        walk(cluster, vectors, labels, ids, found, same_label)

        rows, held = [], 0
        for batch in batches:
            flat, ends = batch.column("vector").values.to_numpy(zero_copy_only=False), batch.column("vector").offsets.to_numpy()
            rows += [(flat[a:b], label, own) for a, b, label, own in zip(ends, ends[1:], batch.column("label").to_pylist(), batch.column("ids").to_pylist())]
            held += 8 * len(flat) + 200 * batch.num_rows
            if held >= LIST_BYTES:
                search(rows)
                rows, held = [], 0
        search(rows)
        out = [(m["q_id"], best.band, -negative, vec_id) for c, found in zip(known, bests) for m, own in zip(c.members, found) for best in own for negative, vec_id in best.found]
        for start in range(0, len(out), 50_000):
            columns = zip(*out[start : start + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q_id", "band", "score", "vec_id"])

    return candidates.mapInArrow(run, "q_id long, band long, score long, vec_id long")


def search(candidates: DataFrame, queries: DataFrame, centroids: list, k: int, same_label: bool, label: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The best ``k`` of each query(q_id, label, vector, bands) over all candidates, block by block of queries."""
    size = queries.agg(F.coalesce(F.sum(F.size("vector") * 8 + 64), F.lit(0))).first()[0]
    blocks, out = max(1, math.ceil(size / block_bytes)), None
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == block).orderBy("q_id").collect()
        if not rows:
            continue
        model = candidates.sparkSession.sparkContext.broadcast(clusters_of([{"q_id": r["q_id"], "label": r["label"], "vector": list(r["vector"]), "bands": r["bands"] and [tuple(b) for b in r["bands"]]} for r in rows], centroids))
        found = search_block(candidates, model, k, same_label)
        best = found.withColumn("place", F.row_number().over(W.partitionBy("q_id", "band").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k)
        best = settle(best, label)
        out = best if out is None else out.unionByName(best)
    return out if out is not None else candidates.sparkSession.createDataFrame([], "q_id long, band long, score long, vec_id long, place int")


def mine(embeddings: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, share: int = 80, relabel: int = 7, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``embeddings(vec_id, label, embedding)``.

    Anchors are the rows whose vec_id is divisible by ``every``; negatives score from ``share`` percent of the
    positive's score up to that score.
    """
    rows = prepared(embeddings, relabel)
    candidates = settle(candidates_of(rows, max(positives + 1, negatives)), "candidates")
    anchors = settle(rows.filter(F.col("vec_id") % every == 0).distinct(), "anchors")
    queries = settle(anchors.groupBy("label", "vector").agg(F.min("vec_id").alias("q_id")), "queries")
    centroids = centroids_of(queries)
    no_band = F.lit(None).cast("array<struct<high:bigint,low:bigint>>")
    near = search(candidates, queries.withColumn("bands", no_band), centroids, positives + 1, True, "positives", block_bytes)

    # an anchor is itself among its query's first ones, or has no part in them
    own = anchors.join(queries, ["label", "vector"]).select("vec_id", "q_id").withColumnRenamed("vec_id", "anchor_id")
    placed = own.join(near, "q_id").filter("anchor_id <> vec_id")
    placed = placed.withColumn("n", F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= positives)
    placed = placed.select("anchor_id", "q_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    # 100 * s >= share * p is s >= (share * p + 99) div 100 in whole numbers; below 0 a band is empty
    band = F.struct(F.col("score").alias("high"), F.expr(f"({share} * score + 99) div 100").alias("low"))
    bands = near.filter("score >= 0").groupBy("q_id").agg(F.collect_set(band).alias("bands"))
    hard = search(candidates, queries.join(bands, "q_id"), centroids, negatives, False, "negatives", block_bytes)
    hard = hard.select("q_id", F.col("band").alias("positive_score"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return placed.join(hard, ["q_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as alike, cast(list_inner_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, other as positive_id, score as positive_score from s where alike
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
n as (select p.*, other as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, other) as rank
  from p join s on s.anchor_id = p.anchor_id and not alike and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""
