"""Nulls in any column, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from gradelake.llm import audio, embedding_dedup, license_scan, minhash_dedup, packing, pieces, quality, secret_scan, suffix_dedup, url_filter
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} and more{i}" for i in range(30_000))
ROWS = [(1, "a few plain words, said once"), (1, "a few plain words, said once"), (2, None), (3, ""), (4, "   \n "), (None, "no id here"), (None, None), (5, LONG), (6, LONG), (7, "naïve 漢字 🙂 " * 40)]
EXTRA = ["row", "kd", "kt", "node", "hits", "spans", "ids", "score", "comp", "gone_id", "len", "start", "bucket", "media", "length", "piece"]

TEXT_OPERATORS = {
    "secret": secret_scan.secret_scan, "redact": secret_scan.redact, "license": license_scan.license_scan, "suffix": suffix_dedup.suffix_dedup, "strip": suffix_dedup.remove_repeats, "audio": audio.audio_digest,
    "near": minhash_dedup.near_duplicates, "keep_one": minhash_dedup.keep_one, "pieces": pieces.piece_digest, "encode": pieces.encode,
}


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in EXTRA], "text")


@pytest.mark.parametrize("name", sorted(TEXT_OPERATORS))
def test_text_operators(spark, name):
    out = TEXT_OPERATORS[name](docs(spark)).cache()
    gone = {"keep_one": 2}.get(name, 0)  # the repeated row of doc 1 and the long text's second row
    assert out.count() == len(ROWS) - gone
    assert out.where("doc_id is null").count() == 2
    if name == "keep_one":
        assert sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 7]
    assert TEXT_OPERATORS[name](docs(spark, [])).count() == 0


def test_packing(spark):
    out = packing.pack(docs(spark)).collect()
    assert sum(r["doc_id"] is None for r in out) == 2
    seen = {}
    for r in out:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs(spark, [])).count() == 0


def test_repeated_rows_get_equal_results(spark):
    rows = [(r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs(spark)).where("doc_id = 1").collect()]
    assert len(rows) == 2 and len(set(rows)) == 1 and rows[0][1:] == (1, True)
    same = minhash_dedup.near_duplicates(docs(spark)).where("doc_id in (5, 6)").orderBy("doc_id").collect()
    assert [(r["component_id"], r["kept"]) for r in same] == [(5, True), (5, False)]


def test_quality(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (None, 1), (4, 0), (77, 1)], "doc_id long, quality int")
    out = quality.quality_scores(docs(spark), labels)
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.keep_good(docs(spark), labels).columns == docs(spark).columns
    assert quality.quality_scores(docs(spark, []), labels).count() == 0
    none = quality.quality_scores(docs(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, []), (7, [1.0]), (None, [0.0, 1.0]), (8, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit(None).cast("int"))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()]
    assert len(got) == len(rows)
    assert got.count((2, 2, 1, False)) == 2 and (1, 2, 1, True) in got
    assert all((i, 0, i, True) in got for i in (3, 4, 5, 6, 7, 8))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://", "<a href='//x.org/'>"), (None, "https://A.org/x?y", None), (4, "http://b.com/de/x", None), (4, "http://b.com/de/x", None), (5, "x://y://z/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("hit", F.lit(1))
    got = sorted([tuple(r) for r in url_filter.judge(df).collect()], key=str)
    assert len(got) == len(rows)
    assert (1, "", "", None, "allow") in got and (2, "", "", None, "allow") in got
    assert (None, "a.org", "/x", "org/", "allow") in got
    assert got.count((4, "b.com", "/de/x", "com/de/", "block")) == 2
    assert (5, "y:", "//z/", None, "allow") in got
    assert url_filter.judge(df.limit(0)).count() == 0
