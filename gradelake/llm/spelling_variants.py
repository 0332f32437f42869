"""Words that differ by one letter, by anagram hashing.

The key of a word is the sum of the fifth powers of its letters' code points: anagrams share it, and one added,
removed or exchanged letter changes it by a power or a difference of two powers.  Every word
is entered under its key and under its key less each of its letters' values; two words that differ by one letter meet
under one value: an exchange at key less letter on both sides, a removal at key less letter on one side and the whole key on the other.
Values where nobody meets are dropped by a count; only then is letter order verified: words go on with a hash of what stays when
that letter is taken out in its place, and those that agree in it are compared.  They differ in that one letter, so such a
group has no more words than the alphabet has letters, however many anagrams share a value.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

MIN_LETTERS = 6
MIN_COUNT = 5
TIMES = 5
DELETE_ONE_IN = 199
RUNS = re.compile("[A-Za-zÀ-ÿ]+").findall
_MASK = (1 << 63) - 1
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_FLUSH = 400_000


def planted(run: str, doc: bytes) -> str:
    """The run without one letter where the crc32 of ``<doc_id>:<run>`` says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc))
    if h % DELETE_ONE_IN:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _counts(change: Callable[[str, bytes], str] | None, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    head = f"{doc}:".encode()
                    found = Counter(RUNS(text.encode().lower().decode()))  # lower() of bytes changes A-Z alone
                    for word, n in found.items():
                        if len(word) >= least:
                            if change and doc is not None:
                                word = change(word, head)
                                if len(word) < least:
                                    continue
                            total[word] = total.get(word, 0) + n
                    if len(total) > _FLUSH:
                        yield flush()
        if total:
            yield flush()

    return run


def word_counts(docs: DataFrame, least_letters: int = MIN_LETTERS, least_count: int = MIN_COUNT, change: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """Letter runs (A-Z lower-cased) of at least ``least_letters`` that occur ``least_count`` times or more: word, n (long).

    ``change(run, b"<doc_id>:")`` may replace each distinct run of a document (not of rows with a null id).  Counts are summed in
    each task first.  Null texts have no words.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = d.mapInArrow(_counts(change, least_letters), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def anagram_key(word: str) -> int:
    return sum(ord(c) ** 5 for c in word) & _MASK


def rest_hashes(word: str, places: list[int]) -> list[int]:
    """A polynomial hash (modulo 2**61 - 1) of the word without each of these letters, in time that grows with the word and the places, not their product."""
    head, tail, power = [0], [0], [1]
    for c, d in zip(word, reversed(word), strict=True):
        head.append((head[-1] * _BASE + ord(c)) % _PRIME)
        tail.append((tail[-1] + ord(d) * power[-1]) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    n = len(word)
    return [(head[i] * power[n - 1 - i] + tail[n - 1 - i]) % _PRIME for i in places]


def word_hash(word: str) -> int:
    h = 0
    for c in word:
        h = (h * _BASE + ord(c)) % _PRIME
    return h


def _rows(columns: dict[str, pa.DataType], make):
    """A batch function that turns each row (as a tuple) into any number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for row in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in make(*row)]
            cols = zip(*out, strict=True) if out else [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, columns.values(), strict=True)], names=list(columns))

    return run


_LONG, _TEXT = pa.int64(), pa.string()
_VALUE_KINDS = {"value": _LONG, "letter": _TEXT, "word": _TEXT, "own": _LONG, "hash": _LONG}
_PLACE_KINDS = {"value": _LONG, "rest": _LONG, "place": pa.int32(), "own": _LONG, "hash": _LONG}


def _values(word: str) -> list[tuple]:
    """The word's key (no letter), and its key less each of its letters' values."""
    own, h = anagram_key(word), word_hash(word)
    return [(own, None, word, own, h), *(((own - ord(c) ** 5) & _MASK, c, word, own, h) for c in set(word))]


def _places(value: int, letter: str | None, word: str, own: int, h: int) -> list[tuple]:
    """Per place of the letter a hash of what stays without it; a whole word stays as it is, at place -1."""
    if letter is None:
        return [(value, h, -1, own, h)]
    at = [m.start() for m in re.finditer(letter, word)]
    return [(value, rest, i, own, h) for i, rest in zip(at, rest_hashes(word, at), strict=True)]


def near_words(words: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Links between words that differ by one added, removed or exchanged letter: word, near, near_n, both ways, each once.

    words: word (distinct, not null) and n.  No pairs of mere anagrams are made: words that meet under a value go on only with a hash of
    their letters in order, and the few that agree in it are compared letter by letter.
    """
    s = scratch or Scratch(words.sparkSession, "near-words")
    kinds = "value long, letter string, word string, own long, hash long"
    values = s.save(words.select("word").mapInArrow(_rows(_VALUE_KINDS, _values), kinds), "values")
    met = values.groupBy("value").agg(F.count("letter").alias("parts"), F.count("*").alias("rows")).where("parts >= 2 or (parts = 1 and rows > 1)").select("value")
    kept = values.join(met, "value", "left_semi").select(*_VALUE_KINDS)
    kept = s.save(kept.mapInArrow(_rows(_PLACE_KINDS, _places), "value long, rest long, place int, own long, hash long"), "places")
    word_id = F.struct("own", "hash")
    at = kept.where("place >= 0").groupBy("value", "rest", "place").agg(F.collect_list(word_id).alias("words")).where(F.size("words") > 1)
    exchanged = at.select("place", F.explode("words").alias("a"), "words").select("place", "a", F.explode("words").alias("b")).where("a <> b")
    part = kept.where("place >= 0").groupBy("value", "rest", word_id.alias("a")).agg(F.min("place").alias("place"))
    whole = kept.where("place < 0").select(F.col("value").alias("v"), F.col("rest").alias("r"), word_id.alias("b"))
    removed = part.join(whole, (F.col("value") == F.col("v")) & (F.col("rest") == F.col("r"))).select("place", "a", "b")
    links = s.save(exchanged.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True))), "links")
    ids = s.save(values.where("letter is null").select("own", "hash", "word").join(words.select("word", "n"), "word"), "ids")
    a, b = (ids.select(F.struct("own", "hash").alias(x), F.struct("word", "n").alias(f"w{x}")) for x in "ab")
    named = links.join(a, "a").join(b, "b")
    same_head = "left(wa.word, place) = left(wb.word, place)"
    same_tail = "substr(wa.word, place + 2) = substr(wb.word, place + if(removed, 1, 2))"
    named = s.save(named.where(f"{same_head} and {same_tail}").select("wa", "wb", "removed"), "named")
    to = lambda x, y: named.select(F.col(f"{x}.word").alias("word"), F.col(f"{y}.word").alias("near"), F.col(f"{y}.n").alias("near_n"))
    back = named.where("removed").select(F.col("wb.word").alias("word"), F.col("wa.word").alias("near"), F.col("wa.n").alias("near_n"))
    return to("wa", "wb").unionAll(back)


def follow(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """Where a chain of forms ends: word, root, for every word that has a form.  Chains are free of cycles (counts rise); each round halves them."""
    step = scratch.save(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = step.select(F.col("word").alias("w"), F.col("root").alias("r"))
        further = scratch.save(step.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "jump")
        moved = further.where("moved").limit(1).count()
        step = further.select("word", "root")
        if not moved:
            return step


def spelling_variants(docs: DataFrame, least_letters: int = MIN_LETTERS, least_count: int = MIN_COUNT, times: int = TIMES, change: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """Every frequent word with its likely right form: word, form, root, n, n_near, form_n.

    docs: doc_id and text; other columns are not read.  ``form`` is the near word of largest n (ties: smallest in code-point
    order) if that is at least ``times`` the word's own n, else null; ``root`` follows forms to the last one.  ``times`` is above 1, so chains end.
    Null and empty texts have no words; repeated rows count twice; an empty table gives an empty result.
    """
    s = Scratch(docs.sparkSession, "spelling")
    words = s.save(word_counts(docs, least_letters, least_count, change), "words")
    best = near_words(words, s).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    right = F.coalesce(-F.col("best.m") >= F.lit(times) * F.col("n"), F.lit(False))
    judged = words.join(best, "word", "left").select(
        "word", F.when(right, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(right, -F.col("best.m")).alias("form_n")
    )
    judged = s.save(judged, "judged")
    roots = follow(s, judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants over all documents, with the letters that the contract deletes."""
    return spelling_variants(table(spark, sf_dir, "documents"), change=planted)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same by spelling out every word with one letter taken out; crc32 by its table, made from the polynomial.
ORACLE = f"""WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents) WHERE length(run) >= {MIN_LETTERS} GROUP BY 1, 2),
bytes AS (SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS b FROM runs),
hashed AS (SELECT run, n, doc_id, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
changed AS (SELECT n, CASE WHEN doc_id IS NOT NULL AND h % {DELETE_ONE_IN} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= {MIN_LETTERS} GROUP BY 1 HAVING sum(n) >= {MIN_COUNT}),
rests AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, range(1000) r(i) WHERE i < length(word)),
near AS (SELECT a.word, b.word AS near, b.n FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM rests a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS form, max(n) AS form_n FROM near GROUP BY 1),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * w.n THEN form END AS form, CASE WHEN form_n >= {TIMES} * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain(word, tip) AS (SELECT word, word FROM judged UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.tip WHERE j.form IS NOT NULL)
SELECT j.word, j.form, c.tip AS root, j.n, j.n_near, j.form_n FROM judged j JOIN chain c USING (word) JOIN judged e ON e.word = c.tip WHERE e.form IS NULL"""
