import zlib

import numpy as np
from gradelake.llm import quality as Q


def texts():
    good = ["The quick fox went over the hill, and then it slept. Nobody saw it again!\nIt was late."] * 2
    return good + ["", "AAA!! BBB!! CCC!!", "a | b | c | d", "xx xx xx xx xx", "é", "line\nline\nline\n", " \n ", "word"]


def test_statistics_of_a_text_do_not_depend_on_its_batch():
    t = texts()
    raw, off = Q.view(Q.pa.array(t))
    whole = Q.statistics(raw, off)
    for i, x in enumerate(t):
        r, o = Q.view(Q.pa.array([x]))
        assert np.allclose(Q.statistics(r, o)[0], whole[i]), x
    assert not whole[2].any()


def test_isotonic_never_falls():
    r = np.random.default_rng(1)
    x = np.sort(r.random(200))
    y = (r.random(200) < x).astype(float)
    kx, ky = Q.isotonic(x, y, np.ones(200))
    assert (np.diff(ky) >= 0).all() and (np.diff(kx) >= 0).all()
    fit = np.interp(x, kx, ky)
    assert abs(fit.mean() - y.mean()) < 1e-9
    assert ((fit - y) ** 2).sum() <= ((y.mean() - y) ** 2).sum()


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.row.doc_id: r for r in Q.quality_scores(d.select("doc_id", "text"), labels).collect()}
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    out = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p == y for p, y in out]) > 0.93
    kept = Q.keep_good(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(1, "a b", 3), (1, "a b", 3), (2, None, 4), (None, "c", 5), (4, "", 6)], "doc_id long, text string, score int")
    assert Q.quality_scores(d, labels).count() == 5
    assert Q.quality_scores(d.limit(0), labels).count() == 0
    assert {r.score for r in Q.quality_scores(d, labels.limit(0)).collect()} == {0.5}


def plain_isotonic(y):
    """Least-squares non-falling values of ``y`` by the min-max formula."""
    return np.array([max(min(y[a : b + 1].mean() for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))])


def test_isotonic_against_the_min_max_formula():
    r = np.random.default_rng(5)
    for n in (1, 2, 30, 60):
        x, y = np.sort(r.random(n)), r.integers(0, 2, n).astype(float)
        assert np.allclose(np.interp(x, *Q.isotonic(x, y, np.ones(n))), plain_isotonic(y))


def test_scores_against_dense_kernel_ridge_and_calibration_out_of_fold(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {r.row.doc_id: r.score for r in Q.quality_scores(d, labels).collect()}
    docs = {r.doc_id: r.text for r in d.collect()}
    ids = sorted(docs)
    x = np.array([Q.statistics(*Q.view(Q.pa.array([docs[i] or ""])))[0] for i in ids])
    mean, sd = x.mean(0), x.std(0)
    z = np.clip((x - mean) / np.where(sd > 1e-9, sd, 1.0), -6, 6)
    r = np.random.default_rng(Q.SEED)
    w = r.standard_normal((x.shape[1], Q.FEATURES)) / (Q.WIDTH * np.sqrt(x.shape[1]) / 3)
    b = r.uniform(0, 2 * np.pi, Q.FEATURES)
    phi = np.column_stack([np.sqrt(2 / Q.FEATURES) * np.cos(z @ w + b), np.ones(len(ids))])
    y = {q.doc_id: q.quality for q in labels.collect() if q.quality is not None and zlib.crc32(str(q.doc_id).encode()) % 5}
    fold = {q.id: q.f for q in spark.range(max(ids) + 1).selectExpr("id", f"pmod(xxhash64(id), {Q.FOLDS}) as f").collect()}
    rows = [k for k, i in enumerate(ids) if i in y]
    t, f = np.array([y[ids[k]] for k in rows], float), np.array([fold[ids[k]] for k in rows])

    def ridge(p, t):  # the least of |p w - t|^2 + penalty |w|^2, as a longer least-squares system
        p, t = np.vstack([p, np.diag(np.sqrt(Q.RIDGE * len(p) * np.array([*[1 / Q.FEATURES] * Q.FEATURES, 1e-9])))]), np.append(t, np.zeros(Q.FEATURES + 1))
        return np.linalg.lstsq(p, t, rcond=None)[0]

    raw = np.zeros(len(rows))
    for k in range(Q.FOLDS):
        raw[f == k] = phi[rows][f == k] @ ridge(phi[rows][f != k], t[f != k])
    step = np.floor(np.clip(raw, -1, 2) * Q.STEPS)
    bins = sorted(set(step))
    at, share, n = (np.array([g(step == s) for s in bins]) for g in (lambda m: raw[m].mean(), lambda m: t[m].mean(), lambda m: float(m.sum())))
    want = np.clip(np.interp(phi @ ridge(phi[rows], t), *Q.isotonic(at, share, n)), 0, 1)
    have = np.array([got[i] for i in ids])
    # the calibration has steps: at a step, rounding may tip a score to either side
    assert np.mean(np.abs(have - want) < 1e-4) > 0.97
