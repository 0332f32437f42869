import random
import re

import numpy as np
import pandas as pd
from gradelake.llm import minhash_dedup as M

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    s = [sets(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]) or rows[i][0] == rows[j][0] and rows[i][1] == rows[j][1] and s[i]:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(s[i]), low[root(i)], d == low[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n, spread):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgÄé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.8:
            w = (r.choice(rows)[1] or "x").split()
            for _ in range(r.randint(0, spread)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
        else:
            rows.append((i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 40, 120])))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, rows[0][1].upper()), (5, rows[5][1])]


def test_against_brute_force(spark):
    for seed, k, num, den in ((1, 3, 85, 100), (2, 5, 80, 100)):
        rows = corpus(seed, 220, 4)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = sorted(tuple(x) for x in M.near_duplicates(df, k, num, den).collect())
        assert got == brute(rows, k, num, den)


def test_groups_that_a_star_does_not_settle(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(i % 9):
            w[r.randrange(100)] = f"x{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(x) for x in M.near_duplicates(df, 3, 85, 100).collect())
    assert got == brute(rows, 3, 85, 100)


def test_blocks_find_every_link():
    r = np.random.default_rng(1)
    whole = [np.unique(r.integers(0, 40, 30)) for _ in range(60)]
    pdf = pd.DataFrame({"comp": range(60), "block": [i % 2 for i in range(60)], "items": whole})
    out = M.block_links(80, 100)((0, 0, 1), pdf)
    want = {(i, j) for i in range(0, 60, 2) for j in range(1, 60, 2) if 5 * len(np.intersect1d(whole[i], whole[j])) >= 4 * len(np.union1d(whole[i], whole[j]))}
    assert {tuple(x) for x in out.to_numpy().tolist()} <= want
    assert bool(want) == bool(len(out))


def test_densification_estimates_similarity():
    r = np.random.default_rng(3)
    for n in (12, 60, 900):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], r.integers(0, 2**63, n // 10).astype(np.uint64)]))
        sig = M.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 2000)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - j) < 0.13


def test_empty_table_and_keep_one(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f g", 1), (2, "A b c d e f g", 2), (3, None, 3)], "doc_id long, text string, node int")
    out = M.keep_one(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_keep_one_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as C

    r = random.Random(4)
    long = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(90))
    twice, null_copy, null_only, shared, other, last = (long() for _ in range(6))
    rows = [(1, twice), (1, twice), (1, twice), (2, null_copy), (None, null_copy), (None, null_only), (None, null_only), (5, shared), (9, shared + " end"), (9, other), (None, last), (20, None), (20, None)]
    df = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = C.near_duplicates(spark, df, "")
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    want = sorted([(1, twice), (2, null_copy), (None, null_only), (5, shared), (9, other), (None, last), (20, None), (20, None)], key=key)
    assert kept.columns == df.columns
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=key) == want
    assert sorted(((x.doc_id, x.text or "") for x in C.repeats(spark, kept, "").collect()), key=key) == [(i, t or "") for i, t in want]


def test_sets_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ELEMENTS", 20)
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(24):
        w = list(base)
        for _ in range(i % 9):
            w[r.randrange(100)] = f"x{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(x) for x in M.near_duplicates(df, 3, 85, 100).collect())
    assert got == brute(rows, 3, 85, 100)


def test_an_empty_block_has_no_links():
    pdf = pd.DataFrame({"comp": [1], "block": [1], "items": [np.arange(3)]})
    assert len(M.block_links(80, 100)((0, 0, 1), pdf)) == 0 and len(M.block_links(80, 100)((0, 1, 2), pdf)) == 0


def test_a_large_group_of_low_similarity_is_cut_along_buckets(spark, monkeypatch):
    pairs = []
    monkeypatch.setattr(M, "BLOCK_ROWS", 20)
    real = M._within_buckets

    def counted(s, large, *rest):
        out = real(s, large, *rest)
        pairs.append((large.count(), sum(r["count"] * (r["count"] - 1) // 2 for r in out.groupBy("gid").count().collect())))
        return out

    monkeypatch.setattr(M, "_within_buckets", counted)
    for n in (1500,):
        r = random.Random(5)
        template = [f"t{i}" for i in range(60)]
        rows = []
        for i in range(n):
            own = [f"o{r.randrange(10**6)}" for _ in range(33)]
            rows.append((i, " ".join([*template, *own]) if i % 10 else rows[-1][1] + " tail" if rows else "x"))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = sorted(tuple(x) for x in M.near_duplicates(df, 3, 85, 100).collect())
        want = {d: (d - 1 if d and d % 10 == 0 else d) for d, _ in rows}
        assert {d: c for d, _, c, _ in got} == want
    ((m, p),) = [x for x in pairs if x[0]]
    assert m > 1300 and p < 0.05 * m * (m - 1) / 2


def test_no_pair_at_the_threshold_is_missed_at_the_registered_parameters(spark):
    """400 pairs of exactly 85 of 100 (34 of 40, 68 of 80 and 136 of 160 shingles), and as many just below it."""
    rows, want = [], {}
    for i in range(400):
        changed = (1, 2, 4)[i % 3]
        words = [f"w{i}x{k}" for k in range(37 * changed + 2)]
        other = list(words)
        for c in range(changed):
            other[5 + 37 * c] += "y"
        below = list(other)
        below[22] += "z"
        doc = 10 * i
        rows += [(doc, " ".join(words)), (doc + 1, " ".join(other)), (doc + 5, " ".join(f"v{x}" for x in words)), (doc + 6, " ".join(f"v{x}" for x in below))]
        want |= {doc: doc, doc + 1: doc, doc + 5: doc + 5, doc + 6: doc + 6}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(df, k=3, num=85, den=100).collect()}
    assert got == want
