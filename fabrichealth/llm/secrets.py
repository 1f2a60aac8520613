"""Secret scan with a random forest for false positives, in DataFrame functions and the JVM's forest only.

A candidate is a run of at least 20 letters, digits and ``+/_-`` inside a word, or a value of at least 8
characters of any kind that is assigned to a key word, in one word or over two or three. Its figures are its length,
the shares of its kinds of characters and how often they change, the share that words of a dictionary cover,
signs of a path or address, and the neighbouring words. The forest is trained from labelled findings and
keeps the candidates it holds for secrets.

Labelled findings: ``weak_labels`` marks what is certain from its form: a value assigned to a key word that
mixes digits and letters is a secret; a plain lower-case word is none, nor is a value that no key word is near
and that is not assigned, has no digits or stands in an address. Others have no label and are what the forest
decides on from the rest. Callers with reviewed findings pass them to ``train`` instead. The fit takes a bounded sample,
``sample`` distinct findings per label at most, so equal findings count once; the dictionary is counted over
the neighbours of all candidates. Without findings of both labels nothing is taken for a secret.

Null or empty texts have no candidate. Repeated rows and candidates give a row each. Extra columns are
passed through by ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabrichealth.llm.common import SPACES, settle

CANDIDATE = r"[A-Za-z0-9+/_\-]{20,}={0,2}"
#: Words that name a secret.
KEY_WORDS = r"token|secret|passw|pwd|credential|bearer|auth|api_?key|access_?key|private_?key"
#: A value assigned to a key word within one word, and the value of such a word.
INLINE = rf"(?i)(?:{KEY_WORDS})[\w\-]*[\"']?[=:][\"'`]?[^\s\"'`=:]{{8,}}"
ASSIGNED_VALUE = r"^(?:.*?[=:])?[\"'`]?([^\s\"'`,;]{8,})"
SAMPLE, DICTIONARY = 10_000, 300
FIGURES = ["length", "digits", "uppers", "lowers", "others", "distinct_share", "changes", "hex", "covered", "slashes", "address", "key_before", "key_near", "assigned", "quoted"]


def candidates(docs: DataFrame, with_columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs(doc_id, text)`` and candidate: word_index, value, word, the two words before and the one after."""
    kept = with_columns or ["doc_id"]
    words = docs.select(*kept, F.split(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)), r"[ \x09-\x0D]+").alias("_w"))
    at = lambda i: F.coalesce(F.get("_w", i), F.lit(""))
    places = F.filter(F.transform("_w", lambda w, i: F.when((F.length(w) >= 20) | _assigned(w, at(i - 1), at(i - 2)), i)), lambda i: i.isNotNull())
    found = words.withColumn("_n", F.size("_w")).withColumn("_at", F.explode(places))
    near = found.select(*kept, F.col("_at").cast("long").alias("word_index"), at(F.col("_at")).alias("word"), at(F.col("_at") - 1).alias("before"), at(F.col("_at") - 2).alias("before2"), at(F.col("_at") + 1).alias("after"))
    value = F.nullif(F.regexp_extract("word", ASSIGNED_VALUE, 1), F.lit(""))
    own = F.filter(F.array(F.when(_assigned(F.col("word"), F.col("before"), F.col("before2")), value)), lambda v: v.isNotNull())
    return near.select("*", F.explode(F.array_union(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)), own)).alias("value"))


def _assigned(word: Column, before: Column, before2: Column) -> Column:
    """A word that holds a value assigned to a key word, here or by the words before; plain tests come first."""
    here = (F.contains(word, F.lit("=")) | F.contains(word, F.lit(":"))) & word.rlike(INLINE)
    sign = F.substring(before, -1, 1).isin("=", ":")
    return (F.length(word) >= 8) & (here | (sign & F.lower(F.concat_ws(" ", before2, before)).rlike(KEY_WORDS)))


def dictionary(found: DataFrame, size: int = DICTIONARY) -> str:
    """A pattern of the most frequent words of 3 letters or more near candidates, longest first."""
    words = found.select(F.explode(F.array("before", "before2", "after")).alias("w")).select(F.regexp_replace(F.lower("w"), r"[^a-z]", "").alias("w")).filter(F.length("w").between(3, 12))
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()
    return "|".join(sorted((r["w"] for r in top), key=lambda w: (-len(w), w))) or "the"


def with_figures(found: DataFrame, words: str) -> DataFrame:
    """Add the figures of candidates; ``words`` is the dictionary's pattern."""
    value, n = F.col("value"), F.length("value")
    share = lambda pattern: (n - F.length(F.regexp_replace(value, pattern, ""))) / n
    kinds = F.translate(F.translate(F.translate(value, "0123456789", "0" * 10), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26), "abcdefghijklmnopqrstuvwxyz", "a" * 26)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    key = F.concat_ws(" ", "before2", "before", F.expr("substring_index(word, value, 1)"))
    flag = lambda c: c.cast("double")
    lead = F.expr("substring_index(word, value, 1)")
    return found.withColumns(
        {
            "length": n.cast("double"),
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "lowers": share("[a-z]"),
            "others": share(r"[^0-9A-Za-z]"),
            "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / n,
            "changes": (runs - 1) / n,
            "hex": flag(value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
            "covered": (n - F.length(F.regexp_replace(F.lower(value), words, ""))) / n,
            "slashes": share("/"),
            "address": flag(F.col("word").rlike(r"://|@|^www\.|^/|\.[a-z]{2,4}/")),
            "key_before": flag(F.lower(lead).rlike(KEY_WORDS) | F.lower("before").rlike(KEY_WORDS)),
            "key_near": flag(F.lower(key).rlike(KEY_WORDS)),
            "assigned": flag(F.concat(F.col("before"), lead).rlike(r"[=:][\"'`]?$")),
            "quoted": flag(lead.rlike(r"[\"'`]$")),
        }
    )


def weak_labels(found: DataFrame) -> DataFrame:
    """Add label: 1.0, 0.0 or null."""
    certain = (F.col("key_near") == 1) & (F.col("assigned") == 1) & (F.col("digits") >= 0.1) & (F.col("uppers") + F.col("lowers") >= 0.1) & (F.col("address") == 0)
    never = ((F.col("key_near") == 0) & ((F.col("digits") == 0) | (F.col("address") == 1) | (F.col("assigned") == 0))) | (F.col("lowers") == 1)
    return found.withColumn("label", F.when(certain, 1.0).when(never, 0.0))


def train(findings: DataFrame, sample: int = SAMPLE, trees: int = 20, depth: int = 6, seed: int = 5):
    """A random forest from ``findings`` with figures and label, or None without both labels."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    order = [F.xxhash64("value", "word", *FIGURES), "value", "word"]
    distinct = findings.select("label", "value", "word", *FIGURES).distinct()
    parts = [distinct.filter(F.col("label") == k).orderBy(*order).limit(sample).select("label", *FIGURES) for k in (0.0, 1.0)]
    rows = settle(parts[0].unionByName(parts[1]).repartition(4), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FIGURES, outputCol="figures")
    return vectors, RandomForestClassifier(labelCol="label", featuresCol="figures", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors.transform(rows))


def classify(found: DataFrame, model) -> DataFrame:
    """Add probability and is_secret."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return found.withColumn("probability", F.lit(0.0)).withColumn("is_secret", F.lit(False))
    vectors, forest = model
    scored = forest.transform(vectors.transform(found)).withColumn("probability", vector_to_array("probability")[1])
    return scored.drop("figures", "rawPrediction", "prediction").withColumn("is_secret", F.col("probability") >= 0.5)


def scan(docs: DataFrame, kept: list[str] | None = None, labeller=weak_labels) -> DataFrame:
    """Every candidate with its figures, probability and is_secret."""
    kept = kept or ["doc_id"]
    found = settle(candidates(docs, kept), "candidates")
    figured = with_figures(found, dictionary(found))
    return classify(figured, train(labeller(figured)))


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, word_index, value, probability and is_secret of every candidate."""
    return scan(docs).select("doc_id", "word_index", "value", "probability", "is_secret")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in its texts replaced; no row is dropped.

    Rows meet their findings by a key of id and text, so rows with equal or null ids are all redacted.
    """
    key, values = "_key", "_values"
    while {key, values} & set(docs.columns):
        key, values = f"{key}_", f"{values}_"
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("string"), "text"))
    secrets = scan(keyed.select(F.col(key), "text"), [key]).filter("is_secret").groupBy(key).agg(F.collect_set("value").alias(values))
    longest_first: Column = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    text = F.aggregate(longest_first, F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark)))
    joined = keyed.join(secrets, key, "left")
    return joined.withColumn("text", F.when(F.col(values).isNotNull(), text).otherwise(F.col("text"))).select(docs.columns)
