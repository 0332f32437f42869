"""Grade prediction with intervals, from dated grades of unequal reliability (closed form, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import clamp, round_half_up, split_normal_cdf

HALF_LIFE, PRIOR_SD, PRIOR_DF, DRIFT, PRIOR_SLOPE, SLOPE_DF, MOST = 120.0, 1.2, 2.0, 0.45, 0.15, 2.0, 3.0
SKEW, SKEW_MOST, MONTH, THIN, CONFIDENCE = 0.06, 0.5, 30.4375, 3, 0.7
#: A source's spread in difficulty and in scale; unknown ones count as the least reliable.
SOURCES = {"OFFICIAL_GSAT": (0.0, 0.0), "EXTERNAL_MOCK": (0.7, 0.4), "INTERNAL_MOCK": (0.7, 1.1)}
UNKNOWN_SOURCE = (0.9, 1.3)


def _source(i: int) -> Column:
    out = F.lit(UNKNOWN_SOURCE[i])
    for name, u in SOURCES.items():
        out = F.when(F.col("source") == name, u[i]).otherwise(out)
    return out


def predict(records: DataFrame, exam_date, keys: list[str]) -> DataFrame:
    """Per key: records, n_eff, weighted_mean, months_ahead, and for three or more records center, sd_down, sd_up.

    Weights halve every HALF_LIFE days before the key's newest record; grades outside 0..15 or without a date are left out.
    """
    fine = records.where("grade between 0 and 15 and exam_date is not null")
    day = F.unix_timestamp("exam_date") / 86400.0
    r = fine.withColumn("day", day).withColumn("newest", F.max("day").over(Window.partitionBy(*keys)))
    r = r.withColumn("t", F.col("day") - F.col("newest")).withColumn("w", F.pow(F.lit(0.5), -F.col("t") / HALF_LIFE))
    w, t, g = F.col("w"), F.col("t"), F.col("grade")
    s = r.groupBy(*keys).agg(
        F.count("*").alias("records"), F.max("newest").alias("newest"), F.sum(w).alias("W"), F.sum(w * w).alias("W2"), F.sum(w * t).alias("wt"), F.sum(w * t * t).alias("wtt"), F.sum(w * g).alias("wg"), F.sum(w * g * g).alias("wgg"), F.sum(w * t * g).alias("wtg"),
        F.sum(w * _source(0) ** 2).alias("wd"), F.sum(w * _source(1) ** 2).alias("wc"),
    )
    c = F.col
    s = s.withColumns({"n_eff": c("W") * c("W") / c("W2"), "mean": c("wg") / c("W"), "anchor": c("wt") / c("W")})
    s = s.withColumn("months", F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(exam_date).cast("timestamp")) / 86400.0 - c("newest") - c("anchor")) / MONTH))
    ss = F.greatest(c("wgg") - c("W") * c("mean") ** 2, F.lit(0.0))
    observed = F.when(c("n_eff") > 1 + 1e-9, ss / c("W") / (1 - 1 / c("n_eff"))).otherwise(PRIOR_SD**2)
    df = F.greatest(F.lit(0.0), c("n_eff") - 1)
    spread = (df * observed + PRIOR_DF * PRIOR_SD**2) / (df + PRIOR_DF) * (1 + 1 / c("n_eff"))
    down = F.sqrt(spread + (c("wd") + c("wc")) / c("W") + DRIFT**2 * c("months"))
    sxx = (c("wtt") - c("W") * c("anchor") ** 2) / MONTH**2
    slope = F.when(sxx > 1e-9, (c("wtg") - c("anchor") * c("wg")) / MONTH / sxx)
    k = F.when(c("n_eff") > 2, (c("n_eff") - 2) / (c("n_eff") - 2 + SLOPE_DF)).otherwise(0.0)
    per_month = F.coalesce(k * slope + (1 - k) * PRIOR_SLOPE, F.lit(PRIOR_SLOPE))
    center = clamp(c("mean") + clamp(per_month * c("months"), -MOST, MOST), 0.0, 15.0)
    s = s.withColumns({"sd_down": down, "center": center}).withColumn("sd_up", c("sd_down") * (1 + F.least(F.lit(SKEW_MOST), SKEW * c("months"))))
    enough = c("records") >= THIN
    rounded = [F.when(enough, round_half_up(x, 4)).alias(x) for x in ("center", "sd_down", "sd_up")]
    return s.select(*keys, "records", round_half_up("n_eff", 3).alias("n_eff"), round_half_up("mean", 3).alias("weighted_mean"), round_half_up("months", 2).alias("months_ahead"), *rounded)


def source_mix(records: DataFrame, keys: list[str]) -> DataFrame:
    """Each source's share of the weight and its count per key."""
    day = F.unix_timestamp("exam_date") / 86400.0
    r = records.withColumn("w", F.pow(F.lit(0.5), (F.max(day).over(Window.partitionBy(*keys)) - day) / HALF_LIFE))
    g = r.groupBy(*keys, "source").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    return g.select(*keys, "source", "n", round_half_up(F.col("w") / F.sum("w").over(Window.partitionBy(*keys)), 4).alias("weight_share"))


def distribution(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Sixteen probabilities per key (tails folded into the ends), to six places."""
    g = predicted.where("center is not null").withColumn("grade", F.explode(F.sequence(F.lit(0), F.lit(15))))
    cdf = lambda x: split_normal_cdf(x, "center", "sd_down", "sd_up")
    low = F.when(F.col("grade") == 0, 0.0).otherwise(cdf(F.col("grade") - 0.5))
    high = F.when(F.col("grade") == 15, 1.0).otherwise(cdf(F.col("grade") + 0.5))
    g = g.withColumn("p", F.greatest(F.lit(0.0), high - low))
    return g.select(*keys, "grade", round_half_up(F.col("p") / F.sum("p").over(Window.partitionBy(*keys)), 6).alias("p"))


def interval(dist: DataFrame, keys: list[str], want: float = CONFIDENCE) -> DataFrame:
    """The shortest run of grades with at least ``want`` mass; more mass wins ties; never a single grade."""
    ps = dist.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("grade", "p"))).alias("d")).withColumn("p", F.transform("d", lambda x: x["p"]))
    mass = lambda lo, hi: round_half_up(F.aggregate(F.slice("p", lo + 1, hi - lo + 1), F.lit(0.0), lambda a, x: a + x), 6)
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda lo: F.transform(F.sequence(lo, F.lit(15)), lambda hi: F.struct((hi - lo).alias("width"), (-mass(lo, hi)).alias("minus"), lo.alias("lo"), hi.alias("hi")))))
    best = ps.withColumn("best", F.array_min(F.filter(runs, lambda r: -r["minus"] + 1e-9 >= want)))
    at = lambda i: F.coalesce(F.try_element_at("p", i + 1), F.lit(-1.0))
    b = best.select(*keys, "p", F.coalesce("best.lo", F.lit(0)).alias("lo"), F.coalesce("best.hi", F.lit(15)).alias("hi"))
    wide = F.col("lo") == F.col("hi")
    up = at(F.col("hi") + 1) >= F.when(F.col("lo") > 0, at(F.greatest(F.col("lo") - 1, F.lit(0)))).otherwise(-1.0)
    b = b.withColumn("widened", wide).withColumn("up", up)
    low, high = F.when(wide & ~F.col("up"), F.col("lo") - 1).otherwise(F.col("lo")), F.when(wide & F.col("up"), F.col("hi") + 1).otherwise(F.col("hi"))
    b = b.select(*keys, "p", low.alias("low"), high.alias("high"), "widened")
    return b.select(*keys, "low", "high", "widened", F.least(F.lit(0.99), round_half_up(mass(F.col("low"), F.col("high")), 2)).alias("confidence"))
