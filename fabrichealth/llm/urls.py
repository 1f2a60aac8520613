"""URL filters: rules first, then host word segmentation and multinomial naive Bayes.

A url's host and path are taken as the contract of ``parts`` says. A rule ``host/path`` fits its host and all
subdomains when the url's path starts with the rule's; the longest rule decides. For the others, host labels
and path tokens are split into words by the most probable unigram segmentation (Viterbi), and multinomial
naive Bayes, learned from the urls that a rule decides, gives the verdict. The last host label is no token.

The unigram model and the Bayes model hold every counted token and stay tables. Their entries of at least
1 / ``share`` of all counts, at most ``share`` of them, are broadcast, as are the runs of letters that are as
frequent; all others are joined by key. ``share`` changes no result.

Null urls or urls without ``://``: empty host and path, no tokens, so the prior decides. Without any decided
url the verdict is allow. Repeated rows are judged one by one, extra columns ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabrichealth.llm.common import LOWER, UPPER, settle

#: The rules (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SHARE = 200_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def longest_rule(rules=RULES) -> Column:
    """The longest fitting rule, or null; ``host`` and ``path`` are columns."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def split_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict."""
    host, path = parts(F.col("url"))
    ruled = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumn("rule", longest_rule(rules))
    verdict = F.lit(None).cast("string")
    for kind, rule in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(kind)).otherwise(verdict)
    return ruled.withColumn("ruled", verdict).drop("url")


def frequent(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows whose share of all of ``n`` is at least 1 / ``share``: at most ``share`` rows."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") * F.lit(share) >= F.lit(total))


def counted(tokens: DataFrame, *key: str) -> DataFrame:
    return settle(tokens.groupBy(*key).agg(F.count("*").alias("n")), "tokens")


def html_words(pages: DataFrame) -> DataFrame:
    """Lower-case words of the pages' text, one a row, the source of the unigram model."""
    text = F.regexp_replace(F.lower(F.coalesce("html", F.lit(""))), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).filter(F.length("word") > 0)


class Segmenter:
    """Splits letters into words by the most probable unigram segmentation.

    A piece that is no known word has a tenth of a count and costs more with each letter. ``lengths`` are those of known
    words, so a piece of another length is unknown without a look; unknown pieces may be of any length.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None, lengths=None):
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.log = {w: math.log(n / self.total) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts} if lengths is None else lengths, reverse=True)
        self.known: dict[str, list[str]] = {}

    def split(self, text: str) -> list[str]:
        if text not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            log, unknown = self.log.get, math.log(0.1 / self.total)
            best, back = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
            open_cost, open_at = -math.inf, 0  # of the best unknown piece that ends here
            for end in range(1, len(text) + 1):
                if best[end - 1] + unknown > open_cost:
                    open_cost, open_at = best[end - 1] + unknown, end - 1
                open_cost -= 2.3
                best[end], back[end] = open_cost, open_at
                for n in self.lengths:
                    if n <= end and (cost := log(text[end - n : end])) is not None and best[end - n] + cost > best[end]:
                        best[end], back[end] = best[end - n] + cost, end - n
            out, at = [], len(text)
            while at:
                out.append(text[back[at] : at])
                at = back[at]
            self.known[text] = out[::-1]
        return self.known[text]

    def split_with(self, text: str, more: dict[str, int]) -> list[str]:
        """``split`` with counts of further words, those of this text."""
        self.log |= {w: math.log(n / self.total) for w, n in more.items()}
        self.known.pop(text, None)
        out = self.split(text)
        self.known.pop(text)
        for w in more:
            del self.log[w]
        return out

    def tokens(self, host: str, path: str) -> list[str]:
        return [place + w for place, run in runs(host, path) for w in (["#"] if run[0].isdigit() else self.split(run))]


def runs(host: str, path: str) -> list[tuple[str, str]]:
    """The runs of letters and of digits of host and path, each with its place."""
    out = [("h:", run) for label in host.split(".")[:-1] for run in re.findall(r"[^\W\d_]+|\d+", label)]
    return out + [("p:", run) for run in re.findall(r"[^\W\d_]+|\d+", path.lower())]


def pieces(letters: DataFrame, words: DataFrame, share: int) -> DataFrame:
    """``letters(run)`` of distinct runs with their pieces, by the whole unigram model ``words(word, n)``."""
    total = words.agg(F.sum("n")).first()[0] or 0
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())  # a few dozen numbers
    shared = words.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in frequent(words, share).collect()})

    def substrings(batches):
        import pyarrow as pa

        for batch in batches:
            found, of = [], []
            for run in batch.column("run").to_pylist():
                own = {run[a : a + n] for n in lengths for a in range(len(run) - n + 1)}
                own = [w for w in own if w not in shared.value]
                found += own
                of += [run] * len(own)
                if len(found) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(found, pa.string())], ["run", "word"])
                    found, of = [], []
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(found, pa.string())], ["run", "word"])

    def split(batches):
        import pyarrow as pa

        segmenter = Segmenter(shared.value, total, lengths)
        for batch in batches:
            found = []
            for run, own in zip(batch.column("run").to_pylist(), batch.column("own").to_pylist()):
                found.append(segmenter.split_with(run, {w["word"]: w["n"] for w in own or []}))
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(found, pa.list_(pa.string()))], ["run", "pieces"])

    own = letters.mapInArrow(substrings, "run string, word string").join(words.select("word", "n"), "word")
    own = own.groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("own"))
    return letters.join(own, "run", "left").select("run", "own").mapInArrow(split, "run string, pieces array<string>")


def segmented(urls: DataFrame, words: DataFrame, share: int = SHARE) -> DataFrame:
    """Add ``tokens`` to a table with _row, host and path; ``words(word, n)`` is the unigram model."""

    def parted(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for row, host, path in zip(*(batch.column(c).to_pylist() for c in ("_row", "host", "path"))):
                rows += [(row, k, place, run) for k, (place, run) in enumerate(runs(host or "", path or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.string()))], ["_row", "at", "place", "run"])

    each = settle(urls.select("_row", "host", "path").mapInArrow(parted, "_row long, at int, place string, run string"), "runs")
    counts = counted(each, "run")
    digits = F.col("run").rlike(r"^\p{Nd}")
    split = settle(pieces(counts.filter(~digits).select("run"), words, share), "pieces")
    hot = F.broadcast(frequent(counts, share).select("run").withColumn("hot", F.lit(True)))
    marked = each.join(hot, "run", "left")
    whole = marked.filter(digits).withColumn("pieces", F.array(F.lit("#"))).select("_row", "at", "place", "pieces")
    for use, of in ((F.col("hot").isNotNull(), F.broadcast(split.join(hot, "run", "left_semi"))), (F.col("hot").isNull(), split)):
        whole = whole.unionByName(marked.filter(use & ~digits).join(of, "run").select("_row", "at", "place", "pieces"))
    tokens = F.transform("pieces", lambda w: F.concat(F.col("place"), w)).alias("t")
    tokens = whole.select("_row", "at", tokens).groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"])).alias("tokens"))
    return urls.join(tokens, "_row", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def verdicts(pages: DataFrame, words: DataFrame, rules=RULES, share: int = SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict, the tokens and the log odds of block against allow."""
    numbered = settle(split_urls(pages, rules).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    urls = settle(segmented(numbered, words, share), "urls")
    classes = dict(urls.filter("ruled is not null").groupBy("ruled").count().collect())
    each = counted(urls.filter("ruled is not null").select("ruled", F.explode("tokens").alias("token")), "token", "ruled")
    of = lambda kind: F.sum(F.when(F.col("ruled") == kind, F.col("n")).otherwise(0))
    counts = settle(each.groupBy("token").agg(of("block").alias("block"), of("allow").alias("allow"), F.sum("n").alias("n")), "counts")
    block, allow, size = (x or 0 for x in counts.agg(F.sum("block"), F.sum("allow"), F.count("*")).first())
    low, high = block + size + 1, allow + size + 1
    weight = F.log((F.col("block") + 1) / F.lit(low)) - F.log((F.col("allow") + 1) / F.lit(high))
    unseen = math.log(1 / low) - math.log(1 / high)
    prior = math.log((classes.get("block", 0) + 1) / (classes.get("allow", 0) + 1)) if classes else -1.0
    model = counts.select("token", "n", weight.alias("weight"))
    hot = F.broadcast(frequent(model, share).select("token", F.col("weight").alias("hot")))
    found = urls.select("_row", F.explode("tokens").alias("token")).join(hot, "token", "left")
    known = found.filter("hot is not null").select("_row", F.col("hot").alias("w"))
    others = found.filter("hot is null").join(model.select("token", "weight"), "token", "left").select("_row", F.coalesce("weight", F.lit(unseen)).alias("w"))
    odds = known.unionByName(others).groupBy("_row").agg(F.sum("w").alias("odds"))
    scored = urls.join(odds, "_row", "left").withColumn("log_odds", F.lit(prior) + F.coalesce("odds", F.lit(0.0)))
    verdict = F.coalesce("ruled", F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.array_join("tokens", " ").alias("tokens"), "log_odds")


def query(pages: DataFrame) -> DataFrame:
    return verdicts(pages, counted(html_words(pages), "word"))
