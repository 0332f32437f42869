"""Text expressions: hashes, legibility, n-grams, trigram similarity (JVM-side; no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

#: Full-width forms and their half-width ones.
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
_DROP = r"[\s!-/:-@\[-`{-~、。，．；：？！「」『』（）《》〈〉—…·]+"


def content_key(text) -> Column:
    """Half-width, without a leading number, punctuation or white space."""
    t = F.translate(F.coalesce(col(text), F.lit("")), FULL, HALF)
    return F.regexp_replace(F.regexp_replace(t, r"^\s*\(?\d{1,3}\s*[.)、]\s*", ""), _DROP, "")


def content_hash(text) -> Column:
    return F.sha2(content_key(text), 256)


def legibility(text) -> Column:
    """OK, SUSPECT or SHORT: at least 120 Han characters are needed, at most 5 % of them from extension A."""
    t = F.coalesce(col(text), F.lit(""))
    han = F.regexp_count(t, F.lit(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"))
    rare = F.regexp_count(t, F.lit(r"[\x{3400}-\x{4DBF}]"))
    return F.when(han < 120, "SHORT").when(rare > 0.05 * han, "SUSPECT").otherwise("OK")


def grams(text, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    t = col(text)
    return F.array_distinct(F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))


def own_share(segment, own, n: int = 4, least: int = 8) -> Column:
    """The share of a segment's n-grams that its author's own text has; 0 for segments below ``least`` characters."""
    g = grams(segment, n)
    return F.when(F.length(col(segment)) < least, 0.0).otherwise(F.size(F.array_intersect(g, grams(own, n))) / F.greatest(F.size(g), F.lit(1)))


def trigrams(text) -> Column:
    """Trigrams of the lower-cased text, two blanks before and one after."""
    return grams(F.concat(F.lit("  "), F.lower(col(text)), F.lit(" ")), 3)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def search_term(text, most: int = 80) -> Column:
    """A trimmed search text, cut; null where nothing is left."""
    return F.nullif(F.trim(F.substring(F.trim(col(text)), 1, most)), F.lit(""))


def like_literal(column, term: str) -> Column:
    """Case-insensitive substring match; %, _ and \\ stand for themselves."""
    safe = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return col(column).ilike(f"%{safe}%")


def strip_html(html) -> Column:
    """Visible text: without scripts, styles, comments and tags, white space folded."""
    t = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " "))


def condensed(text) -> Column:
    """Half-width lower case; only digits, a-z and Han characters stay."""
    return F.regexp_replace(F.lower(F.translate(F.coalesce(col(text), F.lit("")), FULL, HALF)), r"[^0-9a-z\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]+", "")
