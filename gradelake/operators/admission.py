"""Admission rules over profiles and wishes, portfolio counts and monthly usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_key

#: The most wishes of the application channel, and the two kinds of star group (1 to 7, and 8).
MOST_APPLY = 6
GROUP_1_7, GROUP_8, NO_GROUP = "GROUP_1_7", "GROUP_8", "NONE"


def _facts() -> dict[str, Column]:
    """What a profile's flags say; unknown ones count as false, ``same_school_all`` as true."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    star = F.coalesce(F.col("star_category"), F.lit(NO_GROUP))
    return {
        "special": flag("special_admitted") & ~flag("special_waived"), "star": (star != NO_GROUP) & ~flag("star_waived"), "apply": flag("apply_admitted") & ~flag("apply_waived"),
        "repeater": flag("is_repeater"), "same_school": F.coalesce(F.col("same_school_all"), F.lit(True)), "group_1_7": star == GROUP_1_7, "group_8": star == GROUP_8,
    }


def rules() -> dict[str, Column]:
    """Whether each of five actions is open.  What a star admission locks for applications, a waiver does not reopen."""
    f = _facts()
    may_apply = ~f["group_1_7"] & ~f["special"]
    return {
        "SPECIAL_APPLY": F.lit(True),
        "STAR_APPLY": ~f["special"] & ~f["repeater"] & f["same_school"],
        "APPLY_APPLY": may_apply,
        "APPLY_PREFERENCE": may_apply & ~f["group_8"],
        "PLACEMENT_REGISTER": ~f["special"] & ~f["star"] & ~f["apply"],
    }


def eligibility(profiles: DataFrame) -> DataFrame:
    """(user_id, action, ok): five rows for each profile."""
    rows = F.array(*[F.struct(F.lit(name).alias("action"), ok.alias("ok")) for name, ok in rules().items()])
    return profiles.select("user_id", F.explode(rows).alias("r")).select("user_id", "r.action", "r.ok")


def conflicts(profiles: DataFrame, wishes: DataFrame) -> DataFrame:
    """(user_id, code): combinations of wishes that exclude each other or are closed already.

    wishes: user_id, channel (SPECIAL, STAR, APPLY, PLACEMENT), institution, star_group.
    One grouped count per user, then one row for each rule that holds.
    """
    n = lambda channel, also=F.lit(True): F.count_if((F.col("channel") == channel) & also)
    star = F.col("channel") == "STAR"
    g = wishes.groupBy("user_id").agg(
        n("SPECIAL").alias("special"), n("STAR").alias("star"), n("APPLY").alias("apply"), n("PLACEMENT").alias("placement"), n("STAR", F.col("star_group").between(1, 7)).alias("low"), n("STAR", F.col("star_group") == 8).alias("high"),
        F.countDistinct(F.when(star, F.struct("institution", "star_group"))).alias("places"),
    )
    open_ = rules()
    j = g.join(profiles.select("user_id", *[ok.alias(f"may_{a}") for a, ok in open_.items()]), "user_id")
    has = lambda c: F.col(c) > 0
    codes = {
        "STAR_1_7_KILLS_APPLY": has("low") & has("apply"),
        "STAR_8_KILLS_APPLY_PREFERENCE": has("high") & has("apply"),
        "EARLIER_CHANNEL_KILLS_PLACEMENT": has("placement") & (has("star") | has("apply")),
        "SPECIAL_KILLS_EVERYTHING": has("special") & (has("star") | has("apply") | has("placement")),
        "ALREADY_BLOCKED_STAR": has("star") & ~F.col("may_STAR_APPLY"),
        "ALREADY_BLOCKED_APPLY": has("apply") & ~F.col("may_APPLY_APPLY"),
        "ALREADY_BLOCKED_PLACEMENT": has("placement") & ~F.col("may_PLACEMENT_REGISTER"),
        "APPLY_PREFERENCE_BLOCKED": has("apply") & F.col("may_APPLY_APPLY") & ~F.col("may_APPLY_PREFERENCE"),
        "APPLY_OVER_LIMIT": F.col("apply") > MOST_APPLY,
        "STAR_MULTI_POSITION": F.col("places") > 1,
    }
    return j.select("user_id", F.explode(F.array_compact(F.array(*[F.when(ok, F.lit(c)) for c, ok in codes.items()]))).alias("code"))


def upload_counts(items: DataFrame, most: dict[str, int]) -> DataFrame:
    """Per user and grade year: outcomes and diverse pieces used and still free; summary essays do not count.

    items: user_id, grade_year, kind (OUTCOME, DIVERSE, SUMMARY).
    """
    g = items.groupBy("user_id", "grade_year").agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in most])
    return g.select("*", *[F.greatest(F.lit(m) - F.col(k.lower()), F.lit(0)).alias(f"{k.lower()}_left") for k, m in most.items()], *[(F.col(k.lower()) > m).alias(f"{k.lower()}_over") for k, m in most.items()])


def selected_counts(items: DataFrame, programs: DataFrame) -> DataFrame:
    """Per user and requested program how many pieces are selected for it (0 rows appear); items: user_id, selected_for."""
    chosen = items.select("user_id", F.explode("selected_for").alias("program")).groupBy("user_id", "program").agg(F.count("*").alias("n"))
    return programs.join(chosen, ["user_id", "program"], "left").select("user_id", "program", F.coalesce("n", F.lit(0)).alias("n"))


def monthly_tokens(logs: DataFrame, at: str = "at", tokens: str = "tokens", price: float = 0.0) -> DataFrame:
    """Per tenant and UTC month ("yyyy-MM"): calls, tokens and cost at ``price`` a million tokens."""
    g = logs.groupBy("tenant_id", F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"))
    return g.withColumn("cost", F.floor(F.col("tokens") * price / 1e6 * 1e6 + 0.5) / 1e6)


def rank_rows(lines: DataFrame) -> DataFrame:
    """Rank lists as imported: line, username, percentile, semesters and problem (null: the row is used).

    lines: line, username, percentile, semesters (texts).  Blank rows go; full-width digits and
    percent signs are accepted; the value lies in 0..100; of several good lines of a
    username the first counts; semesters default to 5.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    r = lines.select("line", text("username").alias("username"), text("percentile").alias("raw"), text("semesters").alias("sem")).where("username <> '' or raw <> ''")
    v = F.trim(F.translate("raw", "０１２３４５６７８９．%％", "0123456789.")).try_cast("double")
    r = r.withColumn("v", F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))
    bad = F.when(F.col("username") == "", "NO_USERNAME").when(F.col("v").isNull(), "NOT_A_NUMBER").when((F.col("v") < 0) | (F.col("v") > 100), "OUT_OF_RANGE")
    r = r.withColumn("bad", bad)
    first = r.where("bad is null").groupBy("username").agg(F.min("line").alias("first_line"))
    r = r.join(first, "username", "left")
    problem = F.when((F.col("username") != "") & (F.col("line") > F.col("first_line")), "DUPLICATE").otherwise(F.col("bad"))
    used = problem.isNull()
    return r.select("line", "username", F.when(used, F.col("v")).alias("percentile"), F.when(used, F.coalesce(F.col("sem").try_cast("double"), F.lit(5.0))).alias("semesters"), problem.alias("problem"))


def roster_plan(rows: DataFrame, users: DataFrame) -> DataFrame:
    """What an import would do: (username, action) with CREATE, RENAME, KEEP or a problem; rows and users: username, name."""
    r = rows.select("username", "name").where("username is not null")
    u = users.select("username", F.col("name").alias("old_name"), F.lit(True).alias("known"))
    twice = r.groupBy("username").agg(F.count("*").alias("times"), F.min("name").alias("name"))
    j = twice.join(u, "username", "left")
    action = F.when(F.col("times") > 1, "DUPLICATE").when(F.coalesce(F.trim("name"), F.lit("")) == "", "NO_NAME").when(F.col("known").isNull(), "CREATE").when(content_key("name") != content_key("old_name"), "RENAME").otherwise("KEEP")
    return j.select("username", action.alias("action"))


def roc_year(at: Column) -> Column:
    """Admission year: the ROC year, which turns on 1 August."""
    return F.year(at) - 1911 - F.when(F.month(at) < 8, 1).otherwise(0)
