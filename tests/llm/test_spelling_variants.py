import random
import re
import zlib
from collections import Counter

import pytest
from gradelake.llm import spelling_variants as V
from gradelake.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute(docs, letters=6, least=5, times=5, plant=True):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if plant and doc is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    out, form = {}, {}
    for w in n:
        links = [x for x in n if near(w, x)]
        best = min(links, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
        out[w] = len(links)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def test_every_document(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in V.op11(spark, SF).collect())
    assert got == brute(docs) and any(r[1] for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_links_of_random_words(spark, seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("abàÿ" if seed else "ab") for _ in range(r.randint(1, 7))) for _ in range(250)})
    df = spark.createDataFrame([(w, 1 + i) for i, w in enumerate(words)], "word string, n long").repartition(3)
    got = sorted((x.word, x.near, x.near_n) for x in V.near_words(df).collect())
    assert got == sorted((a, b, 1 + words.index(b)) for a in words for b in words if near(a, b))


def test_chains_and_ties(spark):
    many = {"colour": 1000, "coloure": 1000, "colouer": 3, "colur": 200, "colr": 40, "cor": 8, "xolour": 150, "zzzz": 9}
    text = " ".join(w for w, n in many.items() for _ in range(n))
    docs = [(1, text), (None, "colour " * 2), (2, "Ünïque ÜNÏQUE " * 3)]
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, n int, word string")
    got = {r.word: tuple(r) for r in V.spelling_variants(df, 3, 2).collect()}
    assert sorted(got.values()) == brute(docs, 3, 2, 5, False)
    assert got["cor"][1:3] == ("colr", "colour") and got["colr"][1:3] == ("colur", "colour")
    assert got["Ünïque"][3] == 3 and got["ÜnÏque"][3] == 3


def test_a_value_with_many_anagrams_makes_no_pairs(spark):
    import itertools

    words = ["".join(p) for p in itertools.permutations("abcdefg")]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    s = Scratch(spark, "test")
    assert V.near_words(df, s).count() == 0


def test_long_words_cost_what_they_hold(spark):
    base = "acgt" * 20_000
    words = [base, base[:50_001] + base[50_002:], base[:7] + "x" + base[8:], base + "a"]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = {(words.index(r.word), r.near_n) for r in V.near_words(df).collect()}
    assert got == {(a, b) for a in range(4) for b in range(4) if near(words[a], words[b])} and got >= {(0, 1), (0, 2), (0, 3)}


def test_rest_hashes():
    for word in ("a", "abca", "zÿàz"):
        places = list(range(len(word)))
        assert V.rest_hashes(word, places) == [V.word_hash(word[:i] + word[i + 1 :]) for i in places]


def test_edges(spark):
    long = "nullable " * 50_000 + "a" * 300_000
    rows = [(1, None), (2, ""), (3, " \n"), (None, "ordinary ordinary"), (4, long), (4, long), (5, "ordinary " * 4 + "ordinarx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in V.spelling_variants(df).collect())
    assert got == [("nullable", None, "nullable", 100_000, 0, None), ("ordinary", None, "ordinary", 6, 0, None)]
    assert V.spelling_variants(df.limit(0)).count() == 0
    one = V.word_counts(df, 6, 2).where("length(word) > 99").collect()
    assert [(len(r.word), r.n) for r in one] == [(300_000, 2)]
