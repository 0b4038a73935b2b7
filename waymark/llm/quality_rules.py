"""Quality rules whose cutoffs are risk-controlled on labelled holdouts. DataFrame functions only.

Text measures are columns of one projection. For every stratum and signal a grid of cutoffs is tested from the most
lenient on: the documents labelled good that a cutoff rejects are a binomial count, and a cutoff is admissible while the
exact binomial test shows its false rejection rate to be below `alpha` divided by the number of signals, so that all
signals together stay below `alpha` in each stratum. A text counts once in a stratum, however many copies of it are
labelled, as copies are no independent trials. The counts never fall as cutoffs get stricter, so this is a
fixed-sequence test, which needs no correction along the grid; Bonferroni's divides `delta` by strata times signals.
Of the admissible cutoffs the one of the most documents labelled bad, less `good_cost` for each labelled good, is taken,
of equals the most lenient; a signal without one rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Every signal with its grid of cutoffs; more is worse, and a document above the cutoff is rejected.
SIGNALS = {
    "symbol_share": [round(0.01 * k, 2) for k in range(1, 31)],
    "upper_share": [round(0.02 * k, 2) for k in range(5, 46)],
    "repeat_share": [round(0.01 * k, 2) for k in range(2, 20)],
    "dup_line_share": [round(0.02 * k, 2) for k in range(1, 41)],
    "mark_share": [round(0.01 * k, 2) for k in range(5, 46)],
}


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without text_col and with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the signals.

    Words are runs of anything but white space (\\x20, \\x09-\\x0D). A null text has no words: all counts are 0.
    n_repeat_words counts the words that lie in a 5-word window found twice or more; windows are told apart by 64-bit hashes.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in docs.columns if c != text_col]
    step = docs.select(
        *[F.col(c) for c in rest],
        F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("_w"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, "!?", ""))).cast("long").alias("_marks"),
        F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("_upper"),
        F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("_lines"),
    )
    step = step.select(
        *rest, "word_chars", "n_symbols", "_marks", "_upper",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    step = step.withColumn(
        "_g",
        F.when(F.size("_h") >= 5, F.transform(F.sequence(F.lit(0), F.size("_h") - 5), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(5)]))).otherwise(
            F.expr("cast(array() as array<bigint>)")
        ),
    ).drop("_h")
    step = step.withColumn("_s", F.sort_array("_g"))
    step = step.withColumn("_again", F.exists(F.transform("_s", lambda x, i: (i > 0) & (F.get("_s", i - 1) == x)), lambda x: x)).drop("_s")
    step = step.withColumn("_p", F.when(F.col("_again"), F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_g", "_again")
    step = step.withColumn(
        "_at",
        F.expr("sort_array(transform(filter(_p, (x, i) -> (i > 0 and get(_p, i - 1).h = x.h) or coalesce(get(_p, i + 1).h = x.h, false)), x -> x.i))"),
    ).drop("_p")
    covered = F.expr("aggregate(_at, named_struct('n', 0L, 'end', 0), (a, p) -> named_struct('n', a.n + p + 5 - greatest(p, a.end), 'end', p + 5), a -> a.n)")
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return step.select(
        *rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("_upper", "word_chars").alias("upper_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"),
        share("_marks", "word_chars").alias("mark_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series at x + 10, less the logarithms in between."""
    y = x.cast("double") + 11
    above = F.log(y - 1)
    for j in range(2, 11):
        above = above + F.log(y - j)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - above


def tail_log_p(k: Column, n: Column, risk: float) -> Column:
    """ln P(Bin(n, risk) <= k) for all n; 0.0 (no evidence) where k reaches the mean.

    The tail is the regularised incomplete beta function I(1 - risk; n - k, k + 1), whose continued fraction converges
    below the mean in steps of the order of sqrt(n).
    """
    x, a, b = 1 - risk, (n - k).cast("double"), (k + 1).cast("double")

    def part(v: Column, aa: Column) -> Column:
        d = 1 / (1 + aa * v["d"])
        c = 1 + aa / v["c"]
        return F.struct(c.alias("c"), d.alias("d"), (v["h"] * c * d).alias("h"))

    def step(v: Column, i: Column) -> Column:
        m = i.cast("double")
        v = part(v, m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)))
        return part(v, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m)))

    first = 1 / (1 - (a + b) * x / (a + 1))
    steps = F.sequence(F.lit(1).cast("long"), (100 + 6 * F.sqrt(n.cast("double"))).cast("long"))
    fraction = F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step, lambda v: v["h"])
    log_beta = _log_factorial(n - k - 1) + _log_factorial(k) - _log_factorial(n)
    return F.when(k >= n * risk, F.lit(0.0)).otherwise(a * math.log(x) + b * math.log(risk) - F.log(a) - log_beta + F.log(fraction))


def _over(signal: str) -> Column:
    """By how many cutoffs of its grid a signal is above."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in SIGNALS[signal]]), lambda c: F.col(signal) > c))


def risk_controlled_cutoffs(labelled: DataFrame, stratum: str, good: str, alpha: float = 0.05, delta: float = 0.05, good_cost: int = 20) -> DataFrame:
    """(stratum, one column of cutoffs per signal, null where none is admissible) from labelled(stratum, good boolean, signals).

    Rows with a null label are left out; a null stratum is a stratum of its own.
    """
    risk = alpha / len(SIGNALS)
    long = labelled.where(F.col(good).isNotNull()).select(
        F.col(stratum).alias("_stratum"), F.col(good).alias("_good"),
        F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), _over(s).alias("over")) for s in SIGNALS])).alias("x"),
    )
    counts = long.groupBy("_stratum", "x.signal", "x.over").agg(F.count_if("_good").alias("g"), F.count_if(~F.col("_good")).alias("b"))
    per = counts.groupBy("_stratum", "signal").agg(F.map_from_entries(F.collect_list(F.struct("over", F.struct("g", "b")))).alias("m"), F.sum("g").alias("n"))
    grids = F.create_map(*[x for s, grid in SIGNALS.items() for x in (F.lit(s), F.array(*[F.lit(c) for c in grid]))])
    cells = per.select("_stratum", "signal", "n", "m", F.posexplode(grids[F.col("signal")]).alias("c", "cutoff"))
    above = lambda f: F.aggregate(F.map_entries(F.map_filter("m", lambda o, v: o > F.col("c"))), F.lit(0).cast("long"), lambda a, e: a + e["value"][f])
    cells = cells.select("_stratum", "signal", "n", "cutoff", above("g").alias("k"), above("b").alias("bad"))
    strata = per.select("_stratum").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    cells = cells.crossJoin(F.broadcast(strata))  # one row
    ok = cells.where(tail_log_p(F.col("k"), F.col("n"), risk) <= F.log(F.lit(delta) / (len(SIGNALS) * F.col("strata")))).withColumn("gain", F.col("bad") - good_cost * F.col("k")).where("gain > 0")
    best = ok.groupBy("_stratum", "signal").agg(F.max(F.struct("gain", "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy(F.col("_stratum").alias(stratum)).pivot("signal", list(SIGNALS)).agg(F.first("cutoff"))


#: Strata whose cutoffs (under 100 bytes each) may be sent to every executor.
BROADCAST_STRATA = 50_000


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, good_cost: int = 20) -> DataFrame:
    """For each row of docs: id_col, stratum, the measures, base_failed and kept.

    labels(id_col, quality): 1 good, 0 bad; the lowest value counts where an id or a text is repeated, null labels are left out.
    A null or empty text has no words and fails the base rules; a stratum without labels rejects nothing beyond them.
    Repeated rows get equal rows; an empty table gives none; other columns of either table are ignored.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(stratum).alias("_lang"), F.xxhash64(text_col).alias("_tie"), F.col(text_col).alias("_text"))
    found = written(measures(own, "_text"), "measures")
    known = labels.where("quality IS NOT NULL").groupBy(F.col(id_col).alias("_id")).agg((F.min("quality") > 0).alias("_good"))
    trials = found.where(~base_failed()).join(known, "_id").groupBy("_lang", "_tie").agg(F.min("_good").alias("_good"), *[F.min(s).alias(s) for s in SIGNALS])
    cut = risk_controlled_cutoffs(trials, "_lang", "_good", alpha, delta, good_cost)
    cut = written(cut, "cutoffs").withColumnsRenamed({s: f"_cut_{s}" for s in SIGNALS}).withColumnRenamed("_lang", "_of")
    small = cut.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    out = found.join(F.broadcast(cut) if small else cut, F.col("_lang").eqNullSafe(F.col("_of")), "left")
    failed = F.coalesce(*[F.when(F.col(s) > F.col(f"_cut_{s}"), F.lit(s)) for s in SIGNALS])
    return out.select(
        F.col("_id").alias(id_col), F.col("_lang").alias(stratum), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *SIGNALS,
        base_failed().alias("base_failed"), failed.alias("failed_signal"), (~base_failed() & failed.isNull()).alias("kept"),
    )
