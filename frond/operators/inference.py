"""Tests of significance over whole tables: rank tests with ties, paired predictions, monotone order, sign corrections.

Rows are reduced to counted values and ranks by Spark (``ranks``); what is left for the special functions is one row for each
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frond.functions.special import chi2_tail, normal_tails, sign_test, t_tails
from frond.operators import metrics, stats
from frond.operators.ranks import quantiles, ranked, value_counts

#: Without ties, and with so few rows on one side and pairs of rows at all, the distribution of U is counted out.
EXACT_SIDE, EXACT_PAIRS = 8, 1000


def rank_counts(m: Column, n: Column, most: Column) -> Column:
    """In how many ways m rows among m + n have a Mann-Whitney U of 0, 1, ... ``most``: the first coefficients of the
    Gaussian binomial, by multiplying with (1 - q^(n+i)) and dividing by (1 - q^i) for i = 1..m."""
    places = F.sequence(F.lit(0), most.cast("int"))

    def turn(p: Column, i: Column) -> Column:
        at = lambda j: F.coalesce(F.get(p, j.cast("int")), F.lit(0.0))
        times = F.transform(places, lambda j: at(j) - F.when(j >= n + i, at(j - n - i)).otherwise(0.0))
        back = lambda t, j: F.aggregate(F.sequence(F.lit(0), F.floor(j / i).cast("int")), F.lit(0.0), lambda acc, k: acc + F.coalesce(F.get(t, (j - k * i).cast("int")), F.lit(0.0)))
        return F.element_at(F.transform(F.array(times), lambda t: F.transform(places, lambda j: back(t, j))), 1)

    start = F.transform(places, lambda j: F.when(j == 0, 1.0).otherwise(0.0))
    return F.aggregate(F.sequence(F.lit(1), m.cast("int")), start, turn)


def mann_whitney(df: DataFrame, groups: list[str], value: str, positive: Column) -> DataFrame:
    """n1, n0, u (of the positive rows), auc, cliffs_delta and the two-sided p-value for each group; one row without groups.

    p is exact where there are no ties, one side has at most EXACT_SIDE rows and both at most EXACT_PAIRS pairs; elsewhere it
    is the normal approximation with corrections for ties and continuity. Null where a side is empty; 1 where all values tie.
    Rows without a value don't count.
    """
    counts = value_counts(df.filter(F.col(value).isNotNull()), groups, value, n1=F.count_if(positive))
    r = ranked(counts, groups, value)
    by = r.groupBy(*groups) if groups else r
    tied = F.sum(F.col("n").cast("double") ** 3 - F.col("n"))
    sums = by.agg(
        F.sum("n1").alias("n1"),
        (F.sum("n") - F.sum("n1")).alias("n0"),
        (F.sum(F.col("n1") * F.col("rank")) - F.sum("n1") * (F.sum("n1") + 1) / 2).alias("u"),
        tied.alias("tied"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    pairs, n = n1 * n0, n1 + n0
    sd = F.sqrt(F.greatest(F.lit(0.0), pairs / 12 * (n + 1 - F.col("tied") / (n * (n - 1)))))
    z = (F.abs(F.col("u") - pairs / 2) - 0.5) / sd
    # a distance of 0 gives z < 0 after the correction for continuity, which is certain either way
    approximate = F.when(sd > 0, F.when(z > 0, normal_tails(z)).otherwise(F.lit(1.0))).otherwise(F.lit(1.0))
    low = F.least(F.col("u"), pairs - F.col("u"))
    few, many = F.least("n1", "n0"), F.greatest("n1", "n0")
    ways = lambda most: F.aggregate(rank_counts(few, many, most), F.lit(0.0), lambda a, x: a + x)
    exact = F.least(F.lit(1.0), 2 * ways(low) / ways(pairs))
    by_count = (F.col("tied") == 0) & (few <= EXACT_SIDE) & (pairs <= EXACT_PAIRS)
    area = F.col("u") / pairs
    there = pairs > 0
    return sums.select(
        *groups, "n1", "n0", "u", F.when(there, area).alias("auc"), F.when(there, 2 * area - 1).alias("cliffs_delta"), F.when(there, F.when(by_count, exact).otherwise(approximate)).alias("p")
    )


def separation(df: DataFrame, value: str, level: str, healthy: str, order: list[str]) -> DataFrame:
    """How a score separates ``healthy`` from all other levels: one row with what ``mann_whitney`` says (positive: not
    healthy), and the medians and IQRs of the levels in ``order`` (null for a level without rows)."""
    test = mann_whitney(df.filter(F.col(level).isNotNull()), [], value, F.col(level) != healthy)
    return test.crossJoin(F.broadcast(_by_level(df, value, level, order)))  # one row


def _by_level(df: DataFrame, value: str, level: str, order: list[str]) -> DataFrame:
    rows = df.filter(F.col(value).isNotNull() & F.col(level).isin(order))
    q = quantiles(ranked(value_counts(rows, [level], value), [level], value), [level], value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    one = q.agg(F.map_from_entries(F.collect_list(F.struct(F.col(level), F.struct("q1", "q2", "q3")))).alias("at"))  # a few levels
    at = lambda k: F.try_element_at("at", F.lit(k))
    return one.select(F.array(*[at(k)["q2"] for k in order]).alias("medians"), F.array(*[at(k)["q3"] - at(k)["q1"] for k in order]).alias("iqrs"))


def spearman_test(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """n, rho and its two-sided p-value by Student's distribution for each group: 0 at |rho| = 1, null below three rows or
    without a spread."""
    s = stats.spearman(df, groups, x, y)
    n, rho = F.col("n").cast("double"), F.col("rho")
    left = 1 - rho * rho
    t2 = rho * rho * (n - 2) / left
    p = F.when((n < 3) | rho.isNull(), None).when(left < 1e-15, F.lit(0.0)).otherwise(t_tails(F.sqrt(t2), n - 2))
    return s.withColumn("p", p)


def monotony(df: DataFrame, value: str, level: str, order: list[str]) -> DataFrame:
    """Does a score rise with its level? One row: n, Spearman's rho and p against the level's place in ``order``,
    Kruskal-Wallis H and p over the levels, the levels' medians in order, and whether these rise. Other levels don't count."""
    place = F.create_map(*[F.lit(x) for k, v in enumerate(order) for x in (v, k)])
    rows = df.filter(F.col(value).isNotNull() & F.col(level).isin(order)).select(F.col(level), F.col(value), F.element_at(place, F.col(level)).alias("_place"))
    rho = spearman_test(rows, [], "_place", value).select("n", "rho", F.col("p").alias("rho_p"))
    h = stats.kruskal(rows, value, level).select("k", "h")
    h = h.select(F.when(F.col("k") > 1, F.col("h")).alias("h"), F.when(F.col("k") > 1, chi2_tail(F.col("h"), (F.col("k") - 1).cast("double"))).alias("h_p"))
    medians = _by_level(rows, value, level, order).select("medians")
    known = F.filter("medians", lambda m: m.isNotNull())
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(known) - 1)), lambda i: F.coalesce(F.get(known, i - 1) < F.get(known, i), F.lit(True)))
    return rho.crossJoin(F.broadcast(h)).crossJoin(F.broadcast(medians)).withColumn("rising", rising)  # one row each


def mcnemar(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """``metrics.agreement`` with the exact two-sided p-value of McNemar's test."""
    return metrics.agreement(df, a, b).withColumn("p", sign_test(F.col("n10"), F.col("n01")))


def sign_corrections(long: DataFrame, group: str, feature: str, ordinal: str, value: str) -> DataFrame:
    """For each (group, feature) of a long table: n, rho, p, overall (the feature's rho over all groups) and sign.

    The sign is what ``stats.signs`` makes of them: -1 where a group's own association is significant, opposed to the overall
    one and stronger; else 1.
    """
    own = spearman_test(long, [group, feature], ordinal, value)
    overall = stats.spearman(long, [feature], ordinal, value).select(feature, F.col("rho").alias("overall"))
    return own.join(overall, feature).withColumn("sign", stats.signs(F.col("rho"), F.col("p"), F.col("overall"), F.col("n")))
