"""Partial-credit grading as array expressions; an unknown verdict stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import answers
from .numeric import col


def clean_keys(keys) -> Column:
    """Distinct sorted keys, or null where one is null or below 1 (such an answer needs a review)."""
    k = col(keys)
    bad = F.exists(k, lambda x: x.isNull() | (x < 1))
    return F.when(k.isNull(), F.array().cast("array<int>")).when(~bad, F.array_sort(F.array_distinct(k)))


def single_choice(got, want, score) -> Column:
    """Full for the one right key, 0 for none, several or another; null where the standard answer is not one key."""
    g, w, s = clean_keys(got), clean_keys(want), col(score).cast("double")
    return F.when((F.size(w) != 1) | w.isNull() | g.isNull(), None).when(F.size(g) != 1, 0.0).when(g[0] == w[0], s).otherwise(0.0)


def multi_choice(got, want, n, score, all_or_nothing: bool = False) -> Column:
    """(n - 2k) / n of the score, at least 0, for k keys off; blank is 0; keys beyond n need a review (null)."""
    g, w, m, s = clean_keys(got), clean_keys(want), col(n), col(score).cast("double")
    k = F.size(F.array_except(w, g)) + F.size(F.array_except(g, w))
    review = g.isNull() | w.isNull() | (F.size(w) == 0) | (m <= 0) | F.exists(g, lambda x: x > m)
    part = F.lit(0.0) if all_or_nothing else F.floor(s * F.greatest(m - 2 * k, F.lit(0)) / m * 1e6 + 0.5) / 1e6
    return F.when(review, None).when(F.size(g) == 0, 0.0).when(k == 0, s).otherwise(part)


def short_answer(text, mode, answer, keywords, score) -> Column:
    """EXACT (as a fill-in answer) or CONTAINS (every keyword, in normal form); null without a rule, an answer or keywords, or where unsure."""
    s, every = col(score).cast("double"), answers.holds_all(col(text), col(keywords))
    same = answers.same_text(col(text), col(answer))
    exact = F.when(same == answers.SAME, s).when(same == answers.DIFFERENT, 0.0)
    return F.when(col(mode) == "EXACT", exact).when(col(mode) == "CONTAINS", F.when(every, s).when(~every, 0.0))


def map_display_keys(keys, order) -> Column:
    """Shuffled display keys to canonical ones through the order of options."""
    return F.transform(col(keys), lambda k: F.try_element_at(col(order), k))


def has_answer(keys, text, slots) -> Column:
    some = F.exists(col(slots), lambda s: F.trim(s) != "")
    return (F.coalesce(F.size(col(keys)), F.lit(0)) > 0) | F.coalesce(F.trim(col(text)) != "", F.lit(False)) | F.coalesce(some, F.lit(False))


def verdict(answered, earned, score) -> Column:
    """BLANK, PENDING, CORRECT, PARTIAL or WRONG, in that order."""
    return F.when(~col(answered), "BLANK").when(col(earned).isNull(), "PENDING").when(col(earned) >= col(score), "CORRECT").when(col(earned) > 0, "PARTIAL").otherwise("WRONG")


def regrade(manual, auto, previous) -> Column:
    """A manual score stays; an unknown automatic one keeps what was there."""
    return F.coalesce(col(manual), col(auto), col(previous))


def manual_score(value, most) -> Column:
    """A valid manual score (0 to the most, two places), else null."""
    v = col(value)
    return F.when((v >= 0) & (v <= col(most)) & (F.floor(v * 100 + 0.5) == v * 100), v)
