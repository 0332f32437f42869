import random
import zlib

import numpy as np
import pytest
from gradelake.llm import nnls_packing as N
from gradelake.llm.tokens import document_bpe

SF = "/root/testdata/sf0.001"


def spread(counts, size):
    """Every piece of a histogram by the plan, in plain Python: {sequence: [(offset, length, source length, rank, start)]}."""
    plan, ends = N.make_plan(counts, size)
    out = {}
    for c, n in counts.items():
        rows = plan[plan[:, 0] == c]
        for rank in range(n):
            _, first, each, seq, off, place = rows[rows[:, 1] <= rank][-1]
            s = rank - first
            if place < 0:
                out.setdefault(seq + s // each, []).append((off + s % each * c, c, c, rank, 0))
                continue
            at, start = place + s * c, 0
            while start < c:
                p = at + start
                if p < ends[0]:
                    number, a, b = p // size, p // size * size, p // size * size + size
                else:
                    k = next(i for i in range(1, len(ends)) if p < ends[i])
                    number, a, b = ends[0] // size + k - 1, ends[k - 1], ends[k]
                m = min(c - start, b - p)
                out.setdefault(seq + number, []).append((p - a, m, c, rank, start))
                start += m
    return out, ends


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_each_token_once_without_padding(seed):
    r = random.Random(seed)
    size = r.choice([8, 16, 64, 100])
    counts = {r.randint(1, size): r.choice([1, 2, 7, 200]) for _ in range(r.randint(0, 40))}
    used, ends = spread(counts, size)
    lengths = []
    for parts in used.values():
        at = 0
        for off, n, *_ in sorted(parts):
            assert off == at
            at += n
        lengths.append(at)
    assert all(n == size or n & (n - 1) == 0 for n in lengths)
    assert sum(lengths) == sum(c * n for c, n in counts.items())
    pieces = {}
    for parts in used.values():
        for _, n, c, rank, start in parts:
            pieces.setdefault((c, rank), []).append((start, n))
    assert len(pieces) == sum(counts.values())
    for (c, _), parts in pieces.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == c


def test_combinations_are_all_there():
    lengths = [2, 3, 5, 8, 10]
    want = {tuple(sorted(x)) for a in [0, *lengths] for b in [0, *lengths] for x in [(a, b, 10 - a - b)] if 10 - a - b in [0, *lengths]}
    assert {tuple(map(int, x)) for x in N.combinations(np.array(lengths), 10)} == want


def test_repeat_counts_are_a_least_squares_optimum():
    r = np.random.default_rng(4)
    lengths = np.arange(1, 25)
    counts = np.zeros(25)
    counts[lengths] = r.integers(0, 500, 24)
    combos = N.combinations(lengths, 24)
    x = N.solve_counts(combos, counts, 6000)
    a = np.zeros((25, len(combos)))
    for k in range(3):
        np.add.at(a, (combos[:, k], np.arange(len(combos))), 1)
    a[0] = 0
    slope = a.T @ (a @ x - counts)
    assert (x >= 0).all()
    assert slope.min() > -0.5 and abs(slope[x > 1e-3]).max() < 0.5  # no count wants to grow, none in use wants to move
    few = N.solve_counts(combos, counts)
    best, near = (np.square(a @ v - counts).sum() for v in (x, few))
    assert near <= best + 1e-3 * np.square(counts).sum()


def test_most_tokens_lie_in_solved_combinations():
    r = np.random.default_rng(1)
    counts = dict(enumerate(np.bincount(np.clip(np.exp(r.normal(4, 1, 20_000)).astype(int), 1, 256), minlength=257).tolist()))
    counts.pop(0)
    _, ends = N.make_plan(counts, 256)
    assert ends[-1] < 0.1 * sum(c * n for c, n in counts.items())


def rows_and_brute(docs):
    out = []
    for doc, text in docs:
        ids = np.append(document_bpe()(text or ""), N.END).astype("<u4")
        out.append((doc, ids))
    return out


def check(got, docs, size=N.SIZE):
    """Gapless sequences, and every id of every document once, by the digests."""
    sequences, of = {}, {}
    for p in got:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        of.setdefault(p.doc_id, []).append(p)
    for parts in sequences.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at and n > 0
            at += n
        assert at == size or at & (at - 1) == 0 and at < size
    want = {}
    for doc, ids in rows_and_brute(docs):
        want.setdefault(doc, []).append(ids)
    assert want.keys() == of.keys()
    for doc, texts in want.items():
        assert {p.doc_tokens for p in of[doc]} == {len(t) for t in texts}
        assert sum(p.length for p in of[doc]) == sum(map(len, texts))
        for p in of[doc]:
            assert any(zlib.crc32(t[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and len(t) == p.doc_tokens for t in texts)
        if len(texts) == 1:
            at = 0
            for p in sorted(of[doc], key=lambda p: p.start):
                assert p.start == at
                at += p.length
            assert at == len(texts[0])


def test_every_document(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(N.op13(spark, SF).collect(), docs)


def test_edges(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    docs = [(i, " ".join(r.choice(["alpha", "bêta", "gamma,", "\n"]) for _ in range(r.choice([0, 3, 50, 400, 9000])))) for i in range(60)]
    docs += [(5, docs[5][1]), (None, "x y"), (61, None), (62, ""), (63, "<|endoftext|>" * 3)]
    df = spark.createDataFrame([(*d, 1, None) for d in docs], "doc_id long, text string, length int, ids string").repartition(5)
    packed = N.pack_windows(df)
    assert packed.where(F.length("ids") != 4 * F.col("length")).count() == 0
    check(packed.withColumn("ids_crc32", F.crc32("ids")).collect(), docs)
    assert N.pack_windows(df.limit(0)).count() == 0
