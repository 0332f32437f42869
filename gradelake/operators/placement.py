"""Admission simulation: correlation of subjects, reliability of thresholds, seeded Monte-Carlo draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, let, normal_cdf, round_half_up
from ..functions.randoms import normal

MIN_PAIRS, DEFAULT_CORRELATION, MAX_RHO = 4, 0.4, 0.9
#: Factors by number of official years and by academic years of staleness.
SOURCE_FACTOR, FRESHNESS, FRESHNESS_FLOOR = (0.3, 0.55, 0.8, 1.0), (1.0, 0.9, 0.78, 0.62), 0.45
CORRELATION_PENALTY, FLOOR, GOOD = 0.9, 0.4, 0.7


def pairwise_correlation(records: DataFrame, key: str) -> DataFrame:
    """Per key and pair of subjects: exams in common and the correlation of residuals around each subject's mean.

    The mean is over all records of the subject; of several records of one exam the
    last counts.  Below MIN_PAIRS exams, or without variance, the default stands in.
    """
    mean = records.groupBy(key, "subject_code").agg(F.avg("grade").alias("mean"))
    last = records.groupBy(key, "subject_code", "exam_name").agg(F.max_by("grade", F.struct("exam_date", "record_id")).alias("grade"))
    x = last.join(mean, [key, "subject_code"]).select(key, "exam_name", "subject_code", (F.col("grade") - F.col("mean")).alias("d"))
    a, b = x.select(key, "exam_name", F.col("subject_code").alias("a"), F.col("d").alias("da")), x.select(key, "exam_name", F.col("subject_code").alias("b"), F.col("d").alias("db"))
    g = a.join(b, [key, "exam_name"]).where("a < b").groupBy(key, "a", "b").agg(F.count("*").alias("n"), F.sum(F.col("da") ** 2).alias("sxx"), F.sum(F.col("db") ** 2).alias("syy"), F.sum(F.col("da") * F.col("db")).alias("sxy"))
    subjects = mean.select(key, F.col("subject_code").alias("a"))
    pairs = subjects.join(subjects.withColumnRenamed("a", "b"), key).where("a < b").join(g, [key, "a", "b"], "left")
    r = F.when((F.col("n") >= MIN_PAIRS) & (F.col("sxx") > 1e-9) & (F.col("syy") > 1e-9), clamp(F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")), -1.0, 1.0))
    return pairs.select(key, "a", "b", F.coalesce("n", F.lit(0)).alias("common_exams"), round_half_up(r, 4).alias("observed"), round_half_up(F.coalesce(r, F.lit(DEFAULT_CORRELATION)), 4).alias("used"))


def loadings(pairs: DataFrame, key: str) -> DataFrame:
    """One factor's loading per subject, and whether the correlations are OWN, MIXED or DEFAULT."""
    both = pairs.select(key, F.col("a").alias("subject_code"), "used", "observed").union(pairs.select(key, "b", "used", "observed"))
    g = both.groupBy(key, "subject_code").agg(F.avg("used").alias("rho"))
    source = pairs.groupBy(key).agg(F.when(F.count("observed") == F.count("*"), "OWN").when(F.count("observed") > 0, "MIXED").otherwise("DEFAULT").alias("source"))
    return g.join(source, key).select(key, "subject_code", round_half_up(F.sqrt(clamp("rho", 0.0, MAX_RHO)), 4).alias("loading"), "source")


def reliability(thresholds: DataFrame, key: str, current_year: int, own: bool = True) -> DataFrame:
    """Score and tier of each wish's thresholds: years known x freshness x stability, penalised without own correlations.

    thresholds: key, year, official (boolean), grade.
    """
    g = thresholds.groupBy(key).agg(F.countDistinct(F.when(F.col("official"), F.col("year"))).alias("years"), F.max("year").alias("last"), F.stddev_samp("grade").alias("sd"))
    pick = lambda values, i, rest: F.coalesce(F.try_element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1), F.lit(rest))
    known = pick(SOURCE_FACTOR, F.least("years", F.lit(3)), 1.0)
    fresh = pick(FRESHNESS, F.greatest(F.lit(current_year) - F.col("last"), F.lit(0)), FRESHNESS_FLOOR)
    stable = F.greatest(F.lit(0.5), 1 - F.coalesce("sd", F.lit(0.0)) / 6)
    score = round_half_up(known * fresh * stable * (1.0 if own else CORRELATION_PENALTY), 4)
    tier = F.when(score < FLOOR, "NO_ESTIMATE").when(score < GOOD, "HIGH_UNCERTAINTY").otherwise("NORMAL")
    return g.select(key, "years", score.alias("score"), tier.alias("tier"))


def cumulative(grades: DataFrame, subject: str, grade: str, most: int = 15) -> dict[str, list[float]]:
    """Per subject the share of grades up to 0, 1, ... ``most - 1``, from a table of grades (a bounded summary: subjects times grades)."""
    counts: dict[str, list[int]] = {}
    for r in grades.groupBy(F.col(subject).alias("s"), F.greatest(F.lit(0), F.least(F.col(grade), F.lit(most))).alias("g")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["s"], [0] * (most + 1))[r["g"]] = r["n"]
    return {k: [sum(v[: i + 1]) / sum(v) for i in range(most)] for k, v in counts.items()}


def draw_grades(draws: DataFrame, seed: int, steps: dict[str, list[float]], loading: dict[str, float]) -> DataFrame:
    """``draws`` (draw: a long, not negative) with a grade per subject (in order of names): a one-factor Gaussian copula over discrete marginals (``cumulative``)."""
    names = sorted(steps)
    base = F.col("draw") * (2 * (1 + len(names)))
    out = {}
    drawn = draws.select("draw", normal(seed, base).alias("factor"))  # a column of its own: each subject reads it
    for i, name in enumerate(names):
        lam = min(1.0, max(0.0, loading[name]))
        z = F.lit(lam) * F.col("factor") + F.lit(max(0.0, 1 - lam * lam) ** 0.5) * normal(seed, base + 2 * (i + 1))
        out[name] = grade_at(normal_cdf(z), steps[name])
    return drawn.select("draw", *[c.alias(n) for n, c in out.items()])


def grade_at(u: Column, steps: list[float]) -> Column:
    """The first grade whose cumulative share reaches u, which is worked out once, not for each step."""
    below = F.array(*[F.lit(s) for s in steps])
    return let(u, lambda v: F.size(F.filter(below, lambda s: s < v)))


def evaluate(draws: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """Per draw and wish: passed, or why not (QUALIFY or SIEVE and the stage).

    A spec has ``qualify`` [(subject, least)] and ``stages`` [([subjects], least sum)].
    """
    rows = []
    for name, s in specs.items():
        cause = F.lit(None).cast("string")
        for i, (subjects, least) in reversed(list(enumerate(s["stages"]))):
            cause = F.when(sum((F.col(x) for x in subjects), F.lit(0)) < least, F.lit(f"SIEVE{i}")).otherwise(cause)
        for subject, least in reversed(s["qualify"]):
            cause = F.when(F.col(subject) < least, F.lit("QUALIFY")).otherwise(cause)
        rows.append(F.struct(F.lit(name).alias("wish"), cause.alias("cause")))
    return draws.select("draw", F.explode(F.array(*rows)).alias("r")).select("draw", "r.wish", F.col("r.cause").isNull().alias("passed"), "r.cause")


def pass_rates(results: DataFrame, n: int) -> DataFrame:
    g = results.groupBy("wish").agg(F.count_if("passed").alias("passes"), F.count_if(F.col("cause") == "QUALIFY").alias("failed_qualify"), F.count_if(F.startswith("cause", F.lit("SIEVE"))).alias("failed_sieve"))
    rate = F.col("passes") / n
    return g.withColumn("rate", round_half_up(rate, 4)).withColumn("risk", F.when(rate < 0.3, "SPRINT").when(rate > 0.7, "SAFE").otherwise("STEADY"))


def combo(results: DataFrame, n: int) -> DataFrame:
    """How many draws pass how many wishes."""
    per = results.groupBy("draw").agg(F.count_if("passed").cast("int").alias("passed"))
    return per.groupBy("passed").agg(F.count("*").alias("draws")).withColumn("share", round_half_up(F.col("draws") / n, 4))
