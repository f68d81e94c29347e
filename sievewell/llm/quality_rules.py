"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Fixed rules (few words, much repetition) reject outright. Beyond them a family of cutoffs of rising strictness is
tested on labelled holdout documents, stratum by stratum: at each strictness the number of good documents that it
would reject is compared with ``alpha`` by the exact binomial tail P(Binomial(n, alpha) <= k). Within a stratum the
strictnesses are tested in a fixed order, mild to strict, until one fails, which needs no correction; across the
strata the level ``delta`` is divided by their number (Bonferroni). So with probability 1 - delta at least, no
stratum's share of falsely rejected good documents is above alpha. Strata with too few labels get no further cutoff.

Nulls and odd inputs: a null or wordless text has zero counts and fails the fixed rules (too few words). A null
stratum is one of its own. Several labels of a document count as bad if one is bad. Repeated documents get a row
each. Empty tables give empty results; without labels only the fixed rules hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, materialize

#: Most of the good documents of a stratum that the cutoffs may reject, and the chance that this fails anywhere.
ALPHA, DELTA = 0.01, 0.05

#: Percentages by strictness, mild to strict: symbols to words, repeated to all lines with words, words in repeated
#: windows to words, characters to words.
GRID = {
    "symbols": (400, 300, 200, 150, 100, 75, 50, 40),
    "dup_lines": (90, 80, 70, 60, 50, 45, 40, 35),
    "repeats": (20, 19, 18, 17, 16, 15, 14, 13),
    "word_chars": (6000, 5000, 4000, 3000, 2500, 2000, 1800, 1600),
}
LEVELS = 8
#: Above so many false rejections the binomial tail is bounded (Chernoff) instead of summed; the bound is safe.
SUM_LIMIT = 100_000
#: Up to so many strata the table of cutoffs is broadcast; beyond, Spark chooses how to join it.
BROADCAST_STRATA = 100_000

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_stats(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed, names prefixed.

    A window of five words is repeated if its hash is found at another position of the text: the windows' hashes are
    sorted with their positions inside the row, so there is no shuffle and the work is n log n in the text's length.
    Write the result before filtering on it: a filter that is pushed below would repeat the counts.
    """
    p = prefix
    t, tmp = F.coalesce(F.col(text_col), F.lit("")), [f"__sw_{x}" for x in ("words", "lines", "wins", "same", "at")]
    words, lines, wins, same, at = tmp
    n = F.size(words)
    return (
        docs.withColumn(words, F.filter(F.split(t, SPACE_RUN), lambda w: w != ""))
        .withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
        .withColumn(wins, F.when(n >= 5, F.sort_array(F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.struct(F.xxhash64(F.slice(words, i, 5)).alias("h"), i.alias("i"))))).otherwise(F.expr("array()").cast("array<struct<h:bigint,i:int>>")))
        .withColumn(same, F.zip_with(F.slice(wins, 1, F.greatest(F.size(wins) - 1, F.lit(0))), F.slice(wins, 2, F.greatest(F.size(wins) - 1, F.lit(0))), lambda a, b: a["h"] == b["h"]))
        .withColumn(
            at,
            F.sort_array(
                F.array_compact(
                    F.zip_with(
                        wins,
                        F.zip_with(F.concat(same, F.array(F.lit(False))), F.concat(F.array(F.lit(False)), same), lambda a, b: a | b),
                        lambda w, twice: F.when(twice, w["i"]),
                    )
                )
            ),
        )
        .withColumn(f"{p}n_words", n.cast("long"))
        .withColumn(f"{p}word_chars", F.length(F.translate(t, SPACES, "")).cast("long"))
        .withColumn(f"{p}n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
        .withColumn(f"{p}n_lines", F.size(lines).cast("long"))
        .withColumn(f"{p}n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn(
            f"{p}n_repeat_words",
            F.when(
                F.size(at) > 0,
                F.lit(5) + F.aggregate(F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(F.lit(5), b - a)), F.lit(0), lambda a, b: a + b),
            )
            .otherwise(0)
            .cast("long"),
        )
        .withColumn(f"{p}base_failed", (F.col(f"{p}n_words") < 10) | (F.col(f"{p}n_repeat_words") * 100 > F.col(f"{p}n_words") * 20))
        .drop(*tmp)
    )


def severity(prefix: str = "") -> Column:
    """At how many of the strictnesses, from the strictest on, the document would be rejected."""
    c = lambda x: F.col(prefix + x)
    pairs = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_chars": ("word_chars", "n_words")}
    over = [sum((c(a) * 100 > c(b) * cut).cast("int") for cut in GRID[rule]) for rule, (a, b) in pairs.items()]
    return F.greatest(*over)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly; 1 if k >= n p, a Chernoff bound from above beyond SUM_LIMIT."""
    log_none, odds = n * math.log1p(-p), math.log(p / (1 - p))
    start = F.struct(log_none.alias("term"), log_none.alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        hi, lo = F.greatest(term, acc["sum"]), F.least(term, acc["sum"])
        return F.struct(term.alias("term"), (hi + F.log1p(F.exp(lo - hi))).alias("sum"))

    summed = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))).otherwise(F.expr("array()").cast("array<int>")), start, step, lambda acc: F.exp(acc["sum"]))
    share = k / n
    bound = F.exp(-n * (share * F.log(share / p) + (1 - share) * F.log((1 - share) / (1 - p))))
    return F.when(k >= n * p, 1.0).when(k > SUM_LIMIT, bound).otherwise(F.least(summed, F.lit(1.0)))


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, least): the least severity that is rejected in each stratum.

    measured: doc_id, stratum, severity, base_failed. labels: doc_id, quality (1: good). Holdouts are all labelled
    good documents that pass the fixed rules; the cutoffs to choose from are fixed beforehand, so none is used twice.
    """
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    seen = measured.filter(~F.col("base_failed")).join(good, "doc_id")
    counts = seen.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("severity") > LEVELS - x, 1)).alias(f"k{x}") for x in range(1, LEVELS + 1)])
    strata = max(1, measured.select("stratum").distinct().count())
    passed = sum((binomial_tail(F.col(f"k{x}"), F.col("n"), alpha) <= delta / strata).cast("int") for x in range(1, LEVELS + 1))
    out = counts.select("stratum", (F.lit(LEVELS + 1) - passed).alias("least"))
    return F.broadcast(out) if strata <= BROADCAST_STRATA else out  # a row for each stratum


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", keep: list[str] | None = None, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The columns ``keep`` (the id, by default), the counts, base_failed and kept, for every document.

    Counts are made once and written to the shared folder; only ids, strata and counts (and ``keep``) go there. The
    table of cutoffs has a row for each stratum.
    """
    p = "__sw_"
    keep = keep if keep is not None else [id_col]
    narrow = docs.select(*[F.col(c).alias(f"__in_{c}") for c in keep], F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\x00")).alias("stratum"), F.col(text_col).alias("__sw_text"))
    measured = with_stats(narrow, "__sw_text", p).withColumn("severity", severity(p)).withColumn("base_failed", F.col(f"{p}base_failed")).drop("__sw_text", f"{p}base_failed")
    stats, _ = materialize(measured, "rules")
    cutoffs = calibrate(stats.select("doc_id", "stratum", "severity", "base_failed"), labels, alpha, delta)
    kept = ~F.col("base_failed") & (F.col("severity") < F.coalesce("least", F.lit(LEVELS + 1)))
    return stats.join(cutoffs, "stratum", "left").select(*[F.col(f"__in_{c}").alias(c) for c in keep], *[F.col(p + c).alias(c) for c in STATS if c not in keep], "base_failed", kept.alias("kept"))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs that are kept; all columns.

    Documents that pass the fixed rules are written once, with their severity, so that the counts are made once.
    """
    p = "__sw_"
    # the row number keeps the optimizer from moving the filter, with all that it depends on, below the counts
    counted = with_stats(docs, text_col, p).withColumn(f"{p}row", F.monotonically_increasing_id())
    measured = counted.filter(~F.col(f"{p}base_failed")).withColumn(f"{p}severity", severity(p)).withColumn(f"{p}stratum", F.coalesce(F.col(stratum_col).cast("string"), F.lit("\x00")))
    passed, _ = materialize(measured.select(*[F.col(c) for c in docs.columns], f"{p}severity", f"{p}stratum", f"{p}row"), "passed")
    narrow = passed.select(F.col(id_col).alias("doc_id"), F.col(f"{p}stratum").alias("stratum"), F.col(f"{p}severity").alias("severity"), F.lit(False).alias("base_failed"))
    cutoffs = calibrate(narrow, labels, alpha, delta).withColumnsRenamed({"stratum": f"{p}stratum", "least": f"{p}least"})
    kept = F.col(f"{p}severity") < F.coalesce(f"{p}least", F.lit(LEVELS + 1))
    return passed.join(cutoffs, f"{p}stratum", "left").filter(kept).select(*[F.col(c) for c in docs.columns])
