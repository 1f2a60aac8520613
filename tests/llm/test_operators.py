"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("fabrichealth.llm")

from fabrichealth.llm import bitplanes, components, decontaminate, interpolation, neardup, packing, perspectives, quality, secrets, tokens, toxicity, urls  # noqa: E402

WORDS = ["the", "of", "and", "tion", "heat", "lor", "than", "weh", "ß", "é1", "a,b", "Zz.", "x-y"]


def corpus(n=60, seed=1):
    rnd = random.Random(seed)
    text = lambda k: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "er"]) for _ in range(k))
    rows = [(i, text(rnd.choice([0, 3, 8, 20, 60, 200])), "en") for i in range(n)]
    rows += [(1000, rows[5][1], "fr"), (1001, rows[5][1], None), (1002, None, "en"), (1003, "", "en"), (1004, " \t\n ", "en"), (1005, text(9000), "de")]
    base = text(300).split()
    for k in range(12):
        near = list(base)
        near[k * 20] = f"changed{k}"
        rows.append((2000 + k, " ".join(near), "en"))
    return [*rows, rows[3]]


SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def low(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


# 1


def test_language_model_base_and_split_invariance(docs, empty):
    a = interpolation.score(docs, interpolation.Model(key_tokens=500, slice_tokens=700)).collect()
    rows = corpus()
    assert len(a) == len(rows)
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    counts = collections.Counter(w for i, t, _ in rows if not out[i] for w in [*low(t), b"\n"])
    total, vocabulary = sum(counts.values()), len(counts)
    text = {i: t for i, t, _ in rows}
    for r in a:
        own = [*low(text[r.doc_id]), b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(counts[w] > 0 for w in own), total, out[r.doc_id])
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + vocabulary + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0
    b = {r.doc_id: r.score for r in interpolation.score(docs.repartition(1), interpolation.Model(key_tokens=10**6)).collect()}
    assert all(math.isclose(r.score, b[r.doc_id], rel_tol=1e-9) for r in a)
    assert interpolation.score(empty).count() == 0


def brute_interpolation(rows, deleted=8, rounds=12):
    """Scores by doc_id of a bigram model that gives every training word a symbol of its own."""
    part = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    texts = [(part(i), ["<", *low(t), b"\n"]) for i, t, _ in rows]
    texts = [(2 if p % 7 == 2 else 1 if p // 7 % deleted == 0 else 0, t) for p, t in texts]

    def counted(roles):
        pairs = collections.Counter(q for r, t in texts if r in roles for q in zip(t, t[1:]))
        context, word = collections.Counter(), collections.Counter()
        for (a, b), n in pairs.items():
            context[a] += n
            word[b] += n
        return pairs, context, word

    (pairs, context, word), kept, gone = counted((0, 1)), counted((0,)), counted((1,))[0]
    symbols = len(word) + 1

    def terms(model, a, b):
        pairs, context, word = model
        c = context[a]
        return c.bit_length(), np.array([pairs[a, b] / c if c else 0.0, word[b] / max(1, sum(word.values())), 1 / symbols])

    weights = np.full((interpolation.BUCKETS, 3), 1 / 3)
    weights[0] = 0, 1 / 2, 1 / 2
    held = [(*terms(kept, a, b), n) for (a, b), n in gone.items()]
    for _ in range(rounds):
        sums = np.zeros_like(weights)
        for at, p, n in held:
            sums[at] += n * weights[at] * p / (weights[at] @ p)
        mean = (sums.sum(axis=0) + 1e-3) / (sums.sum() + 3e-3)
        new = (sums + mean) / (sums.sum(axis=1, keepdims=True) + 1)
        new[0, 0] = 0
        new[0] /= new[0].sum()
        moved, weights = np.abs(new - weights).max(), new
        if moved < 1e-3:
            break
    score = lambda t: sum(math.log10(weights[at] @ p) for at, p in (terms((pairs, context, word), a, b) for a, b in zip(t, t[1:])))
    return {i: score(t) for (i, _, _), (_, t) in zip(rows, texts)}


def test_language_model_counts_the_bigrams_of_rare_words(docs):
    rows = corpus()
    wanted = brute_interpolation(rows)
    for size in (dict(key_tokens=50, slice_tokens=1), dict(key_tokens=500, slice_tokens=2000), dict()):
        found = interpolation.score(docs, interpolation.Model(**size)).collect()
        assert len(found) == len(rows)
        assert all(math.isclose(r.score, wanted[r.doc_id], rel_tol=1e-9) for r in found)


def test_language_model_is_normalised():
    rnd = np.random.default_rng(0)
    pair = rnd.integers(0, 4, (8, 7))  # of seven symbols after each of them and the start; the last symbol is never seen
    pair[:, 6] = 0
    symbol, context = pair.sum(axis=0), pair.sum(axis=1)
    weights = np.full((interpolation.BUCKETS, 3), [0.5, 0.3, 0.2])
    for k in np.flatnonzero(context):
        p = 10 ** interpolation.mixed(weights, np.full(7, context[k]), pair[k], symbol, symbol.sum(), 7)
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-9)


def test_long_texts_are_split_between_words(monkeypatch):
    monkeypatch.setattr(interpolation, "PIECE_BYTES", 10)
    for text in (b"", b" ", b"a b", b"Aa bb  cc\tdd\nee ff\x0bgg", b"x" * 35 + b" yy " + b"z" * 12, b"0123456789", b"012345678 9"):
        assert [w for part in interpolation.pieces(text) for w in part] == low(text.decode())


# 2


def test_perspectives(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 1, "assistant", "ho"), (1, None, None, None), (2, 0, "a", ""), (None, 0, "b", "x"), *[(3, k, "u" if k % 2 else "v", f"t{k}") for k in range(20)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(9))
    out = perspectives.rotate(turns, part_turns=8).collect()
    whole = collections.defaultdict(str)
    for r in sorted(out, key=lambda r: (str(r.conv_id), r.speaker, r.part)):
        assert len(whole[r.conv_id, r.speaker]) == r.start
        whole[r.conv_id, r.speaker] += r.rendered
        for span in filter(None, r.mask.split(",")):
            a, b = map(int, span.split("-"))
            assert r.rendered[:a].endswith("<|assistant|>\n") and r.rendered[b] == "\n"
    assert whole[1, "assistant"] == "<|user name=unknown|>\n\n<|user name=user|>\nhi\n<|assistant|>\nho\n"
    assert set(whole) == {(1, "user"), (1, "assistant"), (1, "unknown"), (2, "a"), (None, "b"), (3, "u"), (3, "v")}
    lone = perspectives.rotate(spark.createDataFrame([(None, k, "u" if k % 3 else "v", "t" * k) for k in range(20)] + [("", 1, "w", "x")], "conv_id string, turn int, role string, text string"), part_turns=4).collect()
    lone = {(r.conv_id, r.speaker, r.part): r for r in lone}
    assert len(lone) == 11 and all(lone[None, s, p + 1].start == lone[None, s, p].start + len(lone[None, s, p].rendered) for s in "uv" for p in range(4))
    assert perspectives.rotate(turns.filter("false")).count() == 0
    assert whole[3, "u"].count("<|assistant|>") == 10 and sum(r.n_spoken for r in out if (r.conv_id, r.speaker) == (3, "u")) == 10


# 3


def test_secrets(spark, empty):
    rnd = random.Random(2)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    rows = [(i, f'some words before\ntoken = "{h}" and after it', "en") for i, h in enumerate(hexes)]
    rows += [(100 + i, f"plain {'word' * rnd.randint(5, 9)} text {'Longish' * 4} more https://example.com/{'path' * 6}/x", "en") for i in range(30)]
    rows += [(200, None, "en"), (201, "", None), (None, f'token = "{hexes[0]}"', "en"), (0, rows[0][1], "en")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("value", F.lit("clash"))
    found = secrets.findings(table).collect()
    assert {r.value for r in found if r.is_secret} == set(hexes)
    assert all(not r.is_secret for r in found if r.doc_id is not None and r.doc_id >= 100)
    clean = secrets.redact(table)
    assert clean.columns == table.columns and clean.count() == len(rows)
    assert not [r for r in clean.collect() if any(h in (r.text or "") for h in hexes)]
    assert secrets.findings(empty).count() == 0 and secrets.redact(empty).count() == 0


def test_short_secrets_and_look_alikes(spark):
    rnd = random.Random(3)
    pick = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    hexes = [pick("0123456789abcdef", 40) for _ in range(40)]
    rows = [(i, f'set token = "{h}" now', "en") for i, h in enumerate(hexes)]
    short = ["Tr0ub4dor&3", "hunt3r2!x", "pa55-w0rd#9"]
    rows += [(100, f"use password={short[0]} here", "en"), (101, f"db_pwd: {short[1]} ok", "en"), (102, f'secret = "{short[2]}"', "en")]
    look = lambda: [f"commit {pick('0123456789abcdef', 40)} fixes", f"id {pick('0123456789abcdef', 8)}-e89b-12d3-a456-{pick('0123456789', 12)} of", f"see https://example.com/{pick('longpath', 32)}/page", f"password: {pick('forgotten', 9)}", "the token was lost"]
    rows += [(200 + i, t, "en") for i, t in enumerate(t for _ in range(10) for t in look())]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("_key", F.lit("clash")).withColumn("_values", F.lit("clash"))
    found = secrets.findings(table).collect()
    assert {r.value for r in found if r.is_secret} == {*hexes, *short}
    clean = secrets.redact(table)
    assert clean.columns == table.columns
    assert {r.doc_id: r.text for r in clean.collect() if r.doc_id >= 100} == {**{i: t for i, t, _ in rows if i >= 200}, 100: "use password=[SECRET] here", 101: "db_pwd: [SECRET] ok", 102: 'secret = "[SECRET]"'}


# 4


def brute_components(rows, percent=85):
    sets = {}
    for i, t, _ in rows:
        w = low(t)
        if w:
            sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    flat = [(i, s) for i, many in sets.items() for s in many]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("join", [neardup.Join(), neardup.Join(small_node=3, block=4, max_depth=4)])
def test_near_duplicates(docs, empty, join):
    rows = corpus()
    want = brute_components(rows)
    out = neardup.near_duplicates(docs, join).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.component_id for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    kept = neardup.keep_first(docs, join)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    assert neardup.near_duplicates(empty).count() == 0


def test_texts_of_one_id_link_their_groups(spark):
    rnd = random.Random(3)
    a, b, c, base = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(400)) for _ in range(4))
    rows = [(3, a, "en"), (5, a, "en"), (5, b, "en"), (7, b, "en"), (8, c, "en"), (9, b, "en"), (9, c, "en"), (9, c, "en")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == sorted((i, 3) for i, *_ in rows)
    # a large group of near copies, with a chain that leaves it and documents that share half of it
    words = base.split()
    rows = []
    for k in range(1200):
        near = list(words)
        for at in rnd.sample(range(400), 2):
            near[at] = f"n{k}x{at}"
        rows.append((100 + k, " ".join(near), "en"))
    rows += [(5000 + k, " ".join([*words[13 * (k + 1) :], *(f"c{j}" for j in range(13 * (k + 1)))]), "en") for k in range(4)]
    rows += [(6000 + k, " ".join([*words[:200], *(f"h{k}x{j}" for j in range(200))]), "en") for k in range(300)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i] for i in got if i < 6000} == {100} and all(got[i] == i for i in got if i >= 6000)


def test_components(spark):
    rnd = random.Random(4)
    links = [(k, k + 1) for k in range(50, 90)] + [(rnd.randrange(40), rnd.randrange(40)) for _ in range(25)] + [(7, 7), (51, 50), (51, 50)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    out = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in out} == {i: find(i) for i in root}


# 5


def repeat_words(w):
    n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)})


def test_quality_counts(spark, docs, empty):
    rows = [*corpus(), (3000, "a b c d e f a b c d e f a b c d e\nsame\nsame\n \n \n#*$ <x>", "en"), (3001, "z " * 3000, "en")]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.judged(table, labels).collect()}
    for i, t, _ in rows:
        t, w, r = t or "", words(t), out[i]
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars) == (len(w), sum(len(x.decode()) for x in w)), i
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t)) and r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == repeat_words(w)
        assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w)) and (r.kept == (not r.base_failed))
    assert quality.judged(empty, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    clash = table.withColumns({"n_words": F.lit("x"), "_stratum": F.lit(1), "kept": F.lit(False)})
    rows = quality.keep_good(clash, labels)
    assert rows.columns == clash.columns and all(r.n_words == "x" for r in rows.collect())
    assert sorted(r.doc_id for r in rows.collect()) == sorted(i for i, r in out.items() if r.kept)


def test_quality_thresholds(spark):
    rnd = random.Random(9)
    good = [(i, " ".join(rnd.choice("abcdefghij") * 4 + str(rnd.random())[2:6] for _ in range(30)), "en") for i in range(900)]
    bad = [(5000 + i, " ".join("QW" + str(rnd.random())[2:6] + "!!" for _ in range(30)), "en") for i in range(50)]
    table = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i, *_ in good], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality.judged(table, labels, max_false_rejection=0.09).collect()}
    assert all(out[i] for i, *_ in good) and not any(out[i] for i, *_ in bad)
    none = quality.judged(table, labels, max_false_rejection=0.001)
    assert none.filter("not kept").count() == 0


def test_binomial_cdf(spark):
    rows = [(k, n) for n in (5, 40, 3000) for k in (0, 1, 3) if k <= n]
    out = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in out:
        want = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert math.isclose(r.p, want, rel_tol=1e-9)


# 6 and 10


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD = ["<|endoftext|> a<|startoftext|>b", "it's we'LL x'S don't İstanbul ǅ e\u0301 é ＡＢ １２ ½ a\u00a0b", "日本語 テスト", "\x1c\x1d a\x1cb \x00", "a_b--c 12,345.67 don’t 😀👍🏽", "ſß ŉ Ŀ ²³ ×÷"]


def test_words_encode_as_whole_texts(tokenizer):
    encode = tokens.WordEncoder(tokenizer.to_str())
    texts = [t for _, t, _ in corpus()] + ODD
    got = encode.encode_many([None if t is None else t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_planes_round_trip(mode):
    rnd = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (7, 2), (65_536, 49_408), (1000, 2**32 - 1)):
        ids = rnd.integers(0, top, n, np.uint32, endpoint=False) if n else np.empty(0, np.uint32)
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, mode), n, mode) == ids).all()


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_shards(docs, empty, tokenizer, mode, monkeypatch):
    rows = sorted(corpus(), key=lambda r: r[0])
    want = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t, _ in rows]
    out = bitplanes.read_ids(bitplanes.write_ids(docs, mode=mode)).orderBy("start").collect()
    assert [r.doc_id for r in out] == [r[0] for r in rows]
    assert [bytes(r.ids) for r in out] == [w.tobytes() for w in want]
    assert [r.start for r in out] == [0, *np.cumsum([len(w) for w in want]).tolist()[:-1]] and [r.ids_crc32 for r in out] == [zlib.crc32(w.tobytes()) for w in want]
    assert bitplanes.read_ids(bitplanes.write_ids(empty)).count() == 0


def plain_best_fit(lengths, size):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(free) if room >= n]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= n
        else:
            free.append(size - n)
    return len(free)


def test_runs_pack_as_best_fit_decreasing():
    rnd = random.Random(5)
    for size in (1, 7, 50, 64):
        lengths = [rnd.randint(1, size) for _ in range(300)]
        runs = packing.best_fit_runs(dict(collections.Counter(lengths)), size)
        used = collections.Counter()
        for length, _, many, first, offset in runs:
            for k in range(first, first + many):
                assert used[k] == offset
                used[k] += length
        assert max(used.values()) <= size and sum(used.values()) == sum(lengths) and len(used) == plain_best_fit(lengths, size)


def test_packing(docs, empty, tokenizer):
    rows = corpus()
    out = packing.pack(docs, size=64).collect()
    by_doc = collections.defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert {(r.start, r.length, r.ids_crc32) for r in got} == {(a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for a in range(0, len(ids), 64)}
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(sequences) == plain_best_fit([r.length for r in out], 64)
    assert packing.pack(empty).count() == 0
    whole = packing.pack(docs, size=64, with_ids=True).collect()
    assert len(whole) == len(out) and all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in whole)


# 7


def test_toxicity(spark, empty):
    rnd = random.Random(6)
    clean = lambda k: ". ".join(" ".join(rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) for _ in range(8)) for _ in range(k))
    rows = [(i, clean(6) + (". you are stupid" + rnd.choice(["ly", "er", ""]) + " people. " + clean(2) if i % 4 == 0 else ""), "en") for i in range(400)]
    rows += [(900, None, "en"), (901, "", "en"), (3, rows[3][1], "en")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    out = toxicity.score(table, model).collect()
    assert len(out) == len(rows)
    wrong = [r.doc_id for r in out if r.doc_id < 400 and (r.score >= 0.3) != (r.doc_id % 4 == 0)]
    assert len(wrong) <= 4
    assert all(r.score == 0 for r in out if r.doc_id >= 900)
    assert all("stupid" in r.text for r in toxicity.locate(table, model).collect())
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(table, labels.limit(0)) == (-20.0, {})


# 8


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, empty):
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (6, 15, 24, 33, 47, 58, 70)]
    rows, want = [(900, None, "en"), (901, "", "en"), (902, "...", "en")], set()
    for k in range(140):
        body, item = text(rnd.randint(0, 300)), rnd.randrange(len(items))
        if k % 2:
            leak = list(items[item])
            for _ in range(rnd.randint(0, max(0, int(0.1 * len(leak))))):
                at = rnd.randrange(len(leak))
                leak[at : at + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [leak[at], "new"]])
            body[len(body) // 2 : len(body) // 2] = leak
        rows.append((k, " ".join(w.upper() + rnd.choice(["", ",", "."]) for w in body), "en"))
        want |= {(k, i) for i, it in enumerate(items) if brute_distance(it, body) <= int(0.2 * len(it))}
    table = spark.createDataFrame(rows, SCHEMA).withColumn("distance", F.lit("clash"))
    bench = spark.createDataFrame([*((i, " ".join(it)) for i, it in enumerate(items)), (50, None), (51, ""), (52, "w1 w2")], "item_id long, text string")
    for search in (decontaminate.Search(), decontaminate.Search(block_chars=200)):
        out = decontaminate.find(table, bench, search).collect()
        got = {(r.doc_id, r.item_id) for r in out}
        assert got <= want and len(got) >= 0.95 * len(want)
        assert all(r.distance <= int(0.2 * len(items[r.item_id])) for r in out)
    kept = decontaminate.clean(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {i for i, _ in got}
    assert decontaminate.find(empty, bench).count() == 0


@pytest.mark.parametrize("length", [5, 14, 27, 28, 60, 200])
def test_items_are_found_at_the_full_edit_share(length):
    rnd, search = random.Random(length), decontaminate.Search()
    fresh = lambda: f"w{rnd.randrange(10**7)}"
    items = [[fresh() for _ in range(length)] for _ in range(120)]
    texts = []
    for item in items:
        leak = list(item)
        for _ in range(int(search.edit_share * length)):
            at = rnd.randrange(len(leak))
            leak[at : at + 1] = rnd.choice([[], [fresh()], [leak[at], fresh()]])
        texts.append(" ".join([*(fresh() for _ in range(rnd.randint(0, 60))), *leak, *(fresh() for _ in range(40))]).encode())
    found = {(t, i) for t, i, *_ in decontaminate.Index([(k, " ".join(item).encode()) for k, item in enumerate(items)], search).matches(texts)}
    assert {i == t for t, i in found} == {True} and len(found) >= 0.9 * len(items)


# 9


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        ("HTTP://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
        ("http://x.www.example.com/en/2", "x.www.example.com", "/en/2", "www.example.com/en/"),
        ("https://notexample.com/en/3", "notexample.com", "/en/3", "com/"),
        ("http://a.net/es/x", "a.net", "/es/x", "net/es/"),
        ("http://a.net/ES/x", "a.net", "/ES/x", None),
        ("http://com?/", "com", "", None),
        ("http://a.com", "a.com", "", None),
        ("a.com/x", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
        ("x://y://z.com/p", "y:", "//z.com/p", None),
    ],
)
def test_url_parts_and_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url, "<p>x</p>")], "page_id long, url string, html string")
    r = urls.split_urls(pages).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)


def test_segmentation_and_bayes(spark):
    split = urls.Segmenter({"casino": 50, "win": 40, "free": 60, "bets": 30, "the": 500})
    assert split.split("freebets") == ["free", "bets"] and split.split("casinowin") == ["casino", "win"] and split.split("zq") == ["zq"]
    rows = [(i, f"http://casino{k}win.example.net/fr/{i}", "<p>casino win free news</p>") for i, k in enumerate(["free"] * 20)]
    rows += [(100 + i, f"http://goodnews.site.com/en/{i}", "<p>good news</p>") for i in range(20)]
    rows += [(200, "http://casinowin.x.org/fr/1", "x"), (201, "http://goodnews.x.org/en/1", None), (202, None, None), (202, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("tokens", F.lit("clash"))
    out = {r.page_id: r.verdict for r in urls.query(pages).collect()}
    assert out[200] == "block" and out[201] == "allow" and out[0] == "block" and out[100] == "allow" and 202 in out
    assert urls.query(pages.limit(0)).count() == 0


def test_url_models_keep_the_counts_of_rare_tokens(spark):
    rnd = random.Random(4)
    vocabulary = ["casino", "bonus", "garden", "tools", "recipes", "forum", "zebra", "quilt", "lotto", "spin"]
    hosts = ["a.com", "b.net", "example.com", "shop.org"]
    rows = [(k % 70, f"http://{rnd.choice(vocabulary)}{rnd.choice(vocabulary)}.{rnd.choice(hosts)}/{rnd.choice(['es', 'fr', 'en'])}/{rnd.choice(vocabulary)}{k}", f"<p>{rnd.choice(vocabulary)} {rnd.choice(vocabulary[:3])}") for k in range(80)]
    rows += [(900, None, None), (901, "nothing", "<p>rare"), (None, "http://rarezebra.org/x/unheard", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    words = urls.html_words(pages).groupBy("word").agg(F.count("*").alias("n"))
    split = urls.Segmenter({r.word: r.n for r in words.collect()})
    want = [(r.page_id, r.host, r.path, r.ruled, split.tokens(r.host, r.path)) for r in urls.split_urls(pages).collect()]
    counts = {kind: collections.Counter(t for *_, ruled, own in want if ruled == kind for t in own) for kind in ("block", "allow")}
    size = len(counts["block"] | counts["allow"]) + 1
    log = lambda kind, t: math.log((counts[kind][t] + 1) / (sum(counts[kind].values()) + size))
    n = {kind: sum(r[3] == kind for r in want) for kind in counts}
    prior = math.log((n["block"] + 1) / (n["allow"] + 1))
    order = lambda r: tuple(map(str, r))
    want = sorted(((i, h, p, " ".join(own), round(prior + sum(log("block", t) - log("allow", t) for t in own), 6)) for i, h, p, _, own in want), key=order)
    for share in (5, 200_000):
        found = urls.verdicts(pages, words, share=share).collect()
        assert sorted(((r.page_id, r.host, r.path, r.tokens, round(r.log_odds, 6)) for r in found), key=order) == want


def test_pairs_with_a_first_document_are_compared_once(spark):
    """Near copies that meet their node's first document in many nodes are one candidate link each."""
    join = neardup.Join()
    reps = spark.createDataFrame([(k, bytes(4 * join.minwise)) for k in range(1, 31)], "id long, sig binary")
    rows = spark.createDataFrame([(node, k, 1) for node in range(40) for k in range(1, 31)], "node long, id long, low long")
    assert sorted(map(tuple, neardup.pivot_links(rows, reps, join).collect())) == [(k, 1) for k in range(2, 31)]


def test_a_large_group_does_not_walk_on_for_a_few_others(spark, monkeypatch):
    """A few documents outside a large node's cluster are compared with it there, so its near copies branch no further."""
    rnd, walked = random.Random(9), []
    join = neardup.Join(small_node=16, block=64)
    same = [rnd.randrange(2**32) for _ in range(join.minwise)]
    rows = []
    for k in range(300):
        rows.append((k, [rnd.randrange(2**32) if rnd.random() < 0.03 else x for x in same]))
    # too far from the first document to be linked to it, and one between these and the group
    apart = [rnd.randrange(2**32) if j < 26 else x for j, x in enumerate(same)]
    rows += [(1000 + k, [rnd.randrange(2**32) if 26 <= j < 28 + k else x for j, x in enumerate(apart)]) for k in range(5)]
    rows.append((900, [*apart[:13], *same[13:]]))
    reps = spark.createDataFrame([(k, np.array(x, np.uint32).tobytes()) for k, x in rows], "id long, sig binary").cache()
    branch = neardup.branch

    def counted(rows, join, levels, roots):
        walked.append((roots, rows.count()))
        return branch(rows, join, levels, roots)

    monkeypatch.setattr(neardup, "branch", counted)
    got = {r.id: r.component for r in neardup.candidate_clusters(reps, join).collect()}
    assert {got[k] for k in [*range(300), 900]} == {0}
    assert walked == [(True, 306)]


def test_documents_outside_a_group_meet_all_of_it(spark):
    """Each is linked to a document of the group that it is close to, whichever part and batch that is in."""
    join = neardup.Join(small_node=8, block=16)
    rnd = random.Random(10)
    sig = {k: [rnd.randrange(2**32) for _ in range(join.minwise)] for k in range(700)}
    for k in range(5):
        sig[1000 + k] = sig[137 * k + 3]
    sig[1005] = [rnd.randrange(2**32) for _ in range(join.minwise)]
    reps = spark.createDataFrame([(k, np.array(x, np.uint32).tobytes()) for k, x in sig.items()], "id long, sig binary")
    rows = spark.createDataFrame([(node, k, 0 if k < 1000 else k, 0, len(sig)) for node in (5, 6) for k in sig], "node long, id long, group long, main long, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = sorted(map(tuple, neardup.main_links(rows, reps, join).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted([(1000 + k, 137 * k + 3) for k in range(5)] * 2)
