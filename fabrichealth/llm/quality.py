"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a document whose figure is above a cutoff. Per stratum (language), the labelled good
documents that pass the base rules are the holdout. A cutoff is allowed when an exact binomial test says
that its false rejection rate is at most ``max_false_rejection / number of rules``: with n good documents of
which k are above the cutoff, P(Binomial(n, rate) <= k) <= delta / number of tests (Bonferroni over strata,
rules and cutoffs). Of the allowed cutoffs the smallest is taken; a stratum without one has no such rule.
So with probability 1 - delta no stratum loses more than ``max_false_rejection`` of its good documents.

Null or empty text: all counts 0, fails the base rules. Null language: a stratum of its own. Documents
without a label take part in no holdout; labels with null quality, or on no document, are ignored; of
repeated labels each counts. Repeated rows are judged one by one. Extra columns are passed through by
``keep_good`` and ignored by ``judged``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabrichealth.llm.common import SPACES, UPPER, settle

SYMBOLS = "#*$%&|<>"
NOT_SPACE = r"[^ \x09-\x0D]"
#: The rules' figures, and for each the cutoffs that are tested.
CUTOFFS = {
    "word_length": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
    "symbols": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "dup_lines": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "repeat_words": (0.02, 0.05, 0.1, 0.15, 0.2),
    "upper": (0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "exclamations": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
}


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def with_counts(docs: DataFrame) -> DataFrame:
    """Add the counts of ``docs(text, ...)``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_exclamations.

    Repeated 5-word windows are found by sorting a text's window hashes, so a long text costs n log n.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.withColumn("_text", text).withColumn("_trim", F.btrim(F.col("_text"), F.lit(SPACES)))
    split = first.withColumns(
        {
            "_words": F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", r"[ \x09-\x0D]+")),
            "_lines": F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(NOT_SPACE)),
            "word_chars": F.length(_without(F.col("_text"), SPACES)).cast("long"),
            "n_symbols": (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long"),
            "n_upper": (F.length("_text") - F.length(_without(F.col("_text"), UPPER))).cast("long"),
            "n_exclamations": (F.length("_text") - F.length(_without(F.col("_text"), "!"))).cast("long"),
        }
    )
    hashed = split.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.when(F.size("_words") >= 5, F.transform(F.sequence(F.lit(1), F.size("_words") - 4), lambda i: F.xxhash64(F.slice("_words", i, 5)))),
        }
    ).drop("_words", "_lines", "_text", "_trim")
    repeated = hashed.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.element_at("_sorted", k)
    n = F.size("_sorted")
    twice = repeated.withColumn("_at", F.sort_array(F.transform(F.filter(F.sequence(F.lit(1), n), lambda k: ((k > 1) & (at(F.greatest(k - 1, F.lit(1)))["h"] == at(k)["h"])) | ((k < n) & (at(F.least(k + 1, n))["h"] == at(k)["h"]))), lambda k: at(k)["i"])))
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])
    return twice.withColumn("n_repeat_words", F.when(F.col("_sorted").isNotNull(), covered).otherwise(0).cast("long")).drop("_hashes", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def figures() -> dict[str, Column]:
    """The rules' figures from the counts; 0 where there is nothing to divide by."""
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "word_length": part("word_chars", "n_words"),
        "symbols": part("n_symbols", "word_chars"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "repeat_words": part("n_repeat_words", "n_words"),
        "upper": part("n_upper", "word_chars"),
        "exclamations": part("n_exclamations", "word_chars"),
    }


def binomial_cdf(k: Column, n: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k), summed from each term's logarithm."""
    import math

    step = math.log(rate) - math.log1p(-rate)
    start = n * F.lit(math.log1p(-rate))
    grow = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + F.lit(step)).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i) + F.lit(step))).alias("s"))
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(start.alias("t"), F.exp(start).alias("s")), grow, lambda a: a["s"])


def thresholds(counted: DataFrame, labels: DataFrame, max_false_rejection: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per stratum and a column per rule, null where no cutoff is allowed.

    ``counted`` has doc_id, lang and the counts; ``labels`` has doc_id and quality (1: good). The holdout is
    reduced to counts per stratum before anything is tested.
    """
    good = counted.filter(~base_failed()).join(labels.filter(F.col("quality") == 1).select("doc_id"), "doc_id").withColumns(figures())
    tests = [(rule, cut) for rule, cuts in CUTOFFS.items() for cut in cuts]
    counts = good.groupBy(F.coalesce("lang", F.lit("")).alias("stratum")).agg(F.count("*").alias("n"), *[F.count_if(F.col(rule) > cut).alias(f"k{i}") for i, (rule, cut) in enumerate(tests)])
    rate = max_false_rejection / len(CUTOFFS)
    strata = counts.select(F.count("*")).scalar()
    # a stratum whose k is already above rate * n can't pass, so long sums are never formed for it
    allowed = lambda i: (F.col(f"k{i}") <= F.col("n") * rate) & (binomial_cdf(F.when(F.col(f"k{i}") <= F.col("n") * rate, F.col(f"k{i}")).otherwise(0), F.col("n"), rate) * F.col("_strata") * len(tests) <= delta)
    cuts = {rule: F.least(*[F.when(allowed(i), F.lit(cut)) for i, (r, cut) in enumerate(tests) if r == rule], F.lit(None).cast("double")) for rule in CUTOFFS}
    return counts.withColumn("_strata", strata).select("stratum", *[c.alias(f"cut_{rule}") for rule, c in cuts.items()])


#: Strata up to this many are broadcast; more are joined on their key, where Spark splits a hot stratum.
BROADCAST_STRATA = 10_000


def judge(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add base_failed and kept."""
    small = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    joined = counted.withColumn("_stratum", F.coalesce("lang", F.lit(""))).join(small.withColumnRenamed("stratum", "_stratum"), "_stratum", "left")
    above = F.lit(False)
    for rule, figure in figures().items():
        above = above | F.coalesce(figure > F.col(f"cut_{rule}"), F.lit(False))
    failed = base_failed()
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~above).drop("_stratum", *[f"cut_{r}" for r in CUTOFFS])


def judged(docs: DataFrame, labels: DataFrame, max_false_rejection: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept for ``docs(doc_id, text, lang)``."""
    counted = settle(with_counts(docs.select("doc_id", "lang", "text")).drop("text"), "counts")
    cuts = settle(thresholds(counted, labels, max_false_rejection, delta), "cutoffs")
    return judge(counted, cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, max_false_rejection: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns. Rows are written once beside their counts, so no text is counted twice."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "lang", "text")
    counted = settle(with_counts(packed).drop("text"), "counts")
    cuts = settle(thresholds(counted.withColumn("doc_id", F.col("_row.doc_id")).drop("_row"), labels, max_false_rejection, delta), "cutoffs")
    return judge(counted, cuts).filter("kept").select("_row.*")


def oracle(max_false_rejection: float = 0.05, delta: float = 0.05) -> str:
    """The same rows in DuckDB's SQL."""
    tests = [(rule, cut) for rule, cuts in CUTOFFS.items() for cut in cuts]
    rate = max_false_rejection / len(CUTOFFS)
    values = ", ".join(f"('{r}', cast({c} as double))" for r, c in tests)
    figure = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeat_words": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"), "exclamations": ("n_exclamations", "word_chars")}
    case = "case r.rule " + " ".join(f"when '{r}' then case when {b} > 0 then {a} / {b} else 0 end" for r, (a, b) in figure.items()) + " end"
    return rf"""
with d as (select row_number() over () as row_id, doc_id, lang, coalesce(text, '') as t from documents),
w as (select row_id, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) as lines from d),
g0 as (select row_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5),
g as (select row_id, i, hash(words[i:i+4]) as h from g0),
h as (select row_id, i, count(*) over (partition by row_id, h) as n from g),
p as (select row_id, i, coalesce(lead(i) over (partition by row_id order by i), i + 5) as nxt from h where n > 1),
r5 as (select row_id, sum(least(5, nxt - i)) as n_repeat_words from p group by row_id),
c as (select d.row_id, doc_id, lang, len(words) as n_words, len(lines) as n_lines,
  length(regexp_replace(t, '[ \x09-\x0D]', '', 'g')) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper,
  length(t) - length(replace(t, '!', '')) as n_exclamations,
  len(lines) - len(list_distinct(lines)) as n_dup_lines,
  cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from d join w using (row_id) left join r5 using (row_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c),
r as (select * from (values {values}) v(rule, cut)),
f as (select b.*, r.rule, r.cut, {case} as x from b cross join r),
s as (select coalesce(lang, '') as stratum, rule, cut, count(*) as n, count(*) filter (x > cut) as k
  from f join labels using (doc_id) where quality = 1 and not base_failed group by all),
a as (select stratum, rule, min(cut) as cut from s where k <= n * {rate!r} and
  (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate!r}) + (n - i) * ln(1 - {rate!r})))
   from (select unnest(range(0, k + 1)) as i)) * (select count(distinct stratum) from s) * {len(tests)} <= {delta!r} group by all),
bad as (select distinct row_id from f join a on a.stratum = coalesce(f.lang, '') and a.rule = f.rule where f.x > a.cut)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and row_id not in (select row_id from bad) as kept from b"""
