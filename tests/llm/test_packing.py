import random
import zlib

import numpy as np
from gradelake.llm import packing as P
from gradelake.llm.tokens import byte_bpe


def plain_best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, c in enumerate(bins) if c >= n]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(size - n)
    return sorted(bins)


def expand(counts, size):
    plan = P.best_fit_plan(counts, size)
    used = {}
    for length, n in counts.items():
        rows = plan[plan[:, 0] == length]
        for r in range(n):
            _, first, each, bin_, off = rows[rows[:, 1] <= r][-1]
            used.setdefault(bin_ + (r - first) // each, []).append((off + (r - first) % each * length, length))
    return used


def test_plan_is_best_fit_decreasing():
    for seed in range(40):
        r = random.Random(seed)
        size = r.choice([8, 20, 100])
        lengths = [r.randint(1, size) if seed % 2 else r.choice([1, 3, size // 2, size // 3 + 1]) for _ in range(r.randint(1, 300))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        used = expand(counts, size)
        for parts in used.values():
            at = 0
            for off, n in sorted(parts):
                assert off == at
                at += n
            assert at <= size
        assert sorted(size - sum(n for _, n in p) for p in used.values()) == plain_best_fit(lengths, size)


def test_tree():
    t = P.CapacityTree(10)
    for c in (3, 7, 10):
        t.add(c, 1)
    assert [t.tightest(x) for x in range(11)] == [3, 3, 3, 3, 7, 7, 7, 7, 10, 10, 10]
    t.add(10, -1)
    assert t.tightest(8) is None


def test_ids_equal_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", " ", "a\n  b  \n\n c\t", "Ünïcödé ½ ² 漢字 🙂🙂", "it's we'll I'D '' ''s", "x" * 3000, "<|endoftext|>", "\x1c\x85\xa0 　y", "12 345 6.7%%% $$$ *** a_b"]
    r = random.Random(5)
    texts += ["".join(r.choice(" \n\tabcé'!1²漢 ") for _ in range(200)) for _ in range(50)]
    for text in texts:
        assert byte_bpe()(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_round_trip(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["alpha", "bêta", "gamma,", "\n"]) for _ in range(r.choice([0, 3, 50, 400, 3000])))) for i in range(80)]
    rows += [(5, rows[5][1]), (None, "x y"), (81, None), (82, "")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, length int").repartition(5)
    got = P.pack(df).collect()
    places = {}
    for p in got:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert 1 <= p.length <= 1024
    for parts in places.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 1024
    want = []
    for doc, text in rows:
        ids = np.append(byte_bpe()(text or ""), 2).astype("<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(str(doc), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in got) == sorted(want)
    assert len(places) == len(plain_best_fit([p.length for p in got], 1024))
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_added_tokens_in_texts_are_one_id_each(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|> b\n<|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "x" * 50 + "<|endoftext|>" * 1500, " é 漢<|endoftext|>  y", ""]
    got = {(p.doc_id, p.piece): p for p in P.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    n = 0
    for i, text in enumerate(texts):
        ids = np.append(np.array(t.encode(text, add_special_tokens=False).ids, np.uint32), P.END).astype("<u4")
        first = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], range(first, len(ids) + 1, 1024))):
            n += 1
            assert (got[i, k].start, got[i, k].length, got[i, k].ids_crc32) == (a, b - a, zlib.crc32(ids[a:b].tobytes())), text
    assert n == len(got)
