"""License scans, hard negatives and ranked search against plain versions on small tables."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("fabrichealth.llm")

from fabrichealth.llm import lexical, licenses, negatives  # noqa: E402

DOCS = "doc_id long, text string, lang string, words string, key string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "clash", "clash") for d, t in rows], DOCS).withColumn("score", F.lit(3)).repartition(3)


# 11


def digest(rows):
    return sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in rows), key=str)


def test_licenses_base_phrases_and_templates(spark):
    mit = next(t for label, _, t in licenses.TEMPLATES if label == "mit" and len(t) > 200)
    edited = mit.split()
    for i in (10, 25, 40):
        edited[i] = "changed"
    edited[30:30] = ["two", "more"]
    filler = " ".join(f"w{i}" for i in range(3000))
    rows = [
        (1, "Licensed under CC BY-NC 4.0."),
        (2, "cc, by! CC\nby the GENERAL public\tLicense; all rights reserved"),
        (3, "ccby general public. all rights"),
        (4, f"{filler} {mit} {filler} {mit} Ä"),
        (5, " ".join(edited)),
        (6, " ".join(mit.split()[:20])),
        (7, "Released under the BSD License"),
        (8, "Released under the MIT License"),
        (9, None),
        (10, ""),
        (11, " .\x00; "),
        (None, "Released under the MIT License"),
        (8, "Released under the MIT License"),
        (12, "Released under the ApacKe MİT License cc by"),
        (13, "general " * 4000 + "public license " * 2),
    ]
    out = licenses.scan(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {(r["doc_id"], r["n_words"]): r for r in out}
    text = dict(rows)
    for r in out:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text[r["doc_id"]]))
        at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(ws), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    labels = collections.defaultdict(list)
    for r in out:
        labels[r["doc_id"]].append(r["labels"])
    assert labels[1] == ["cc-by,cc-by-nc"] and labels[2] == ["cc-by,gpl,reserved"] and labels[3] == [""]
    assert labels[4] == ["mit"] and labels[5] == ["mit"] and labels[6] == [""] and labels[7] == [""]
    assert labels[8] == ["mit", "mit"] and labels[None] == ["mit"] and labels[12] == ["cc-by"] and labels[13] == ["gpl"]
    assert [round(x, 3) for x in sorted(s["share"] for s in got[5, len(WORD.findall(" ".join(edited)))]["spans"])] == [round((len(mit.split()) - 3) / len(WORD.findall(mit)), 3)] or got[5, len(WORD.findall(" ".join(edited)))]["score"] > 0.9
    n = len(WORD.findall(mit))
    long = next(r for r in out if r["doc_id"] == 4)
    assert sorted((s["first"], s["last"]) for s in long["spans"]) == [(3000, 3000 + n - 1), (6000 + n, 6000 + 2 * n - 1)]
    assert licenses.scan(frame(spark, [])).count() == 0
    assert licenses.scan(frame(spark, rows), templates=[], phrases={"gnu": "gnu"}).filter("n_base > 0 or score > 0").count() == 0


def test_licenses_paths_agree(spark, monkeypatch):
    """Passages that are joined on their key give the rows of those that are broadcast; no Python works on the rows."""
    rows = [(i, f"x{i} " * (i % 5) + licenses.TEMPLATES[i % len(licenses.TEMPLATES)][2]) for i in range(60)]
    docs = frame(spark, rows)
    a = digest(licenses.scan(docs).collect())
    monkeypatch.setattr(licenses, "BROADCAST_PASSAGES", 0)
    b = licenses.scan(docs)
    assert digest(b.collect()) == a
    assert all(r[6] for r in a)
    assert not re.search("Python|Pandas|Arrow", b._jdf.queryExecution().toString())


# 12


def plain_negatives(rows, positives=5, negatives_=5):
    known = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        known.append((vec_id, [math.floor(256 * x) for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = set()
    for a, u, la in known:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(u, v)), b, lb == la) for b, v, lb in known if b != a and len(v) == len(u))
        for neg_p, p, _ in [s for s in scored if s[2]][:positives]:
            hard = [(s, b) for s, b, alike in scored if not alike and 80 * -neg_p <= 100 * -s <= 100 * -neg_p][:negatives_]
            out |= {(a, p, i + 1, b, -neg_p, -s) for i, (s, b) in enumerate(hard)}
    return out


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, vector string").withColumn("score", F.lit(1)).repartition(4)
    out = negatives.mine(df, **kw).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


def vectors(n, seed, dims=6, spread=0.4):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [round(1024 * (c + rnd.gauss(0, spread))) / 1024 for c in rnd.choice(centres)], rnd.randrange(4)) for i in range(n)]


def test_negatives_equal_plain_search(spark):
    rows = vectors(1500, 1)
    hot = rows[100][1]
    rows += [(10_000 + i, hot, i % 2) for i in range(700)]  # one vector in a third of the rows, anchors among them
    rows += [(20_000, None, 1), (20_100, [1.0] * 6, None), (None, [1.0] * 6, 1), (20_200, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (20_300, [float("nan")] * 6, 1), (20_400, [float("inf")] * 6, 1), (20_500, [0.0] * 6, 2), (20_600, [1.0, 2.0], 2), (20_601, [1.0, 2.5], 1), (20_602, [1.0, 2.3], 3), (20_700, [], 1)]
    want = plain_negatives(rows)
    assert len(want) > 300 and {a for a, *_ in want} >= {100, 10_000, 20_600}
    assert mined(spark, rows) == want
    assert mined(spark, rows, block_bytes=400) == want  # many blocks of queries
    assert mined(spark, [r for r in rows if r[0] == 101]) == set() and mined(spark, []) == set()
    few = rows[:130]
    assert mined(spark, few, positives=2, negatives=3) == plain_negatives(few, 2, 3)


def test_negatives_walks_are_certified(monkeypatch):
    """A walk that ends early finds what a whole one finds, and scores a part of the list."""
    import numpy as np

    rnd = random.Random(3)
    data = np.array([[round(256 * (c + rnd.gauss(0, 0.2))) for c in rnd.choice([[4, 0, 0], [0, 4, 0], [0, 0, 4]])] for _ in range(20_000)])
    labels, ids = np.array([rnd.randrange(4) for _ in data]), [[i] for i in range(len(data))]
    members = [{"q_id": i, "label": int(labels[i]), "vector": data[i].tolist(), "bands": None} for i in range(0, 20_000, 200)]
    scored = []
    for cluster in negatives.clusters_of(members, [np.array(c, float) for c in np.eye(3)]):
        bests = [[negatives.Best(6)] for _ in cluster.members]
        negatives.walk(cluster, data, labels, ids, bests, True, scored.append)
        for m, (best,) in zip(cluster.members, bests):
            s = data @ np.array(m["vector"])
            want = sorted((-int(s[i]), i) for i in np.flatnonzero(labels == m["label"]))[:6]
            assert best.found == want
    assert sum(scored) < 0.5 * len(members) * len(data)


def test_negatives_refuse_scores_beyond_64_bits():
    import numpy as np

    big = np.array([[2**31, 2**31]])
    assert negatives.inner_products(big, np.array([[2**29, 1]])).tolist() == [[2**60 + 2**31]]
    with pytest.raises(ValueError):
        negatives.inner_products(big, np.array([[2**33, 1]]))


# 13


def plain_ranks(docs, items, k=50):
    counted = [(d, collections.Counter(WORD.findall(lower(t)))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = collections.Counter()
    for item_id, text in set(items):
        scored = []
        for d, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(WORD.findall(lower(text))) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out.update((item_id, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k]))
    return out


def ranked(spark, docs, items, **kw):
    asked = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, rank string")
    return collections.Counter(tuple(r) for r in lexical.search(frame(spark, docs), asked, **kw).select("item_id", "rank", "doc_id", "score").collect())


def documents(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "Of", "é", "x9", "Ünd", "a") for b in range(30)]
    text = lambda k: rnd.choice([" ", ", ", "\n"]).join(vocabulary[min(int(rnd.paretovariate(0.6)), len(vocabulary)) - 1] for _ in range(k))
    return [(i, text(rnd.choice([0, 1, 5, 40, 200]))) for i in range(n)], text


def test_search_equals_plain_ranking(spark, monkeypatch):
    docs, text = documents(400, 5)
    copy = text(60)
    docs += [(1000 + i, copy) for i in range(200)] + [(None, copy), (None, "the1"), (5000, None), (5001, ""), (5002, "-- \x00"), (7, copy), (7, copy), (5003, text(20_000))]
    items = [(i, text(rand)) for i, rand in enumerate([1, 5, 30, 30, 120])] + [(50, copy), (51, None), (52, ""), (53, "nowhere seen"), (0, text(3)), (50, copy), (None, "The1 é2")]
    asked = [(i, t or "") for i, t in items]
    want = plain_ranks(docs, asked)
    assert len(want) > 300
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, block_bytes=200) == want  # blocks of items
    assert ranked(spark, docs, items, k=3) == plain_ranks(docs, asked, 3)
    monkeypatch.setattr(lexical, "TRIE_DOCS", 50)
    assert ranked(spark, docs, items) == want
    assert not ranked(spark, [], items) and not ranked(spark, docs, [])


def test_trie_bounds_hold_and_prune():
    """No document below a node scores above the node's bound, and the walk leaves subtrees out."""
    import numpy as np

    rnd = random.Random(7)
    batch = []
    for d in range(3000):
        low = 0 if d % 2 else 20
        terms = np.array(sorted(rnd.sample(range(low, low + 20), rnd.randrange(1, 12))), np.int32)
        batch.append((terms, np.array([rnd.randrange(1, 9) for _ in terms], np.int32), rnd.randrange(50, 200), d))
    item_terms = [rnd.sample(range(20), 6) for _ in range(4)] + [rnd.sample(range(20, 40), 6) for _ in range(4)]
    ranking = lexical.Ranking(item_terms, [rnd.randrange(100, 9000) for _ in range(40)], 10)
    trie = lexical.Trie(lexical.sorted_rows(batch, 10))
    score = lambda row, item: sum(int(ranking.gains(np.array([t]), np.array([f]), row[2])[0]) for t, f in zip(row[0].tolist(), row[1].tolist()) if t in item_terms[item])
    nodes = [(0, len(trie.rows))]
    for low, high in nodes:
        bound = ranking.bound(trie, low, high)
        for row in rnd.sample(trie.rows[low:high], min(5, high - low)):
            assert all(score(row, i) <= bound[i] for i in range(8))
        if high - low > 32:
            parts = trie.children(low, high)
            assert parts[0][0] == low and parts[-1][1] == high and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and len(parts) > 1
            nodes += parts
    ranking.walk(trie)
    for item in range(8):
        want = sorted((-score(r, item), d) for r in trie.rows for d in r[3] if score(r, item) > 0)[:10]
        assert [(-s, d) for i, d, s in ranking.results() if i == item] == want
    assert ranking.skipped > 0
