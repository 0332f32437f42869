import itertools
import random
import re

import numpy as np
from gradelake.llm import pieces as P
from gradelake.llm.tokens import sentence_pieces

ODD = ["", " ", "  ", "a", " a", "a ", "  Hello  world\nx ", "tab\tand\r\nline", "漢字かな 🙂 é́ ﬁ ２ ½", "aaaaaaaaaaaaaaaaaaa", "▁", "a▁ b", " x y", "<s> <0x41> </s> <unk>", "x" * 2000, "= = == ===  ====   =====" * 5]


def test_ids_and_texts_equal_the_library():
    sp, model = sentence_pieces(), P.load_model()
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("abcdefghij éß漢\n  ") for _ in range(300)) for _ in range(60)]
    texts += [" ".join(r.choice(["internationalization", "the", "there", "therefore", "un", "undo", "Schifffahrt", "l'été", "año"]) for _ in range(80)) for _ in range(10)]
    for text, (code, _, _) in zip(texts, model.encode(texts)):
        ids = np.frombuffer(code, np.uint32).tolist()
        assert ids == sp.encode(text), text
        assert model.decode(ids) == sp.decode(ids), text
        assert model.decode(ids) == text.replace("▁", " ")


def test_documents_equal_the_library(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    sp = sentence_pieces()
    for r in P.encode(d.withColumn("ids", d.doc_id)).collect():
        assert r.ids == sp.encode(r.text)
    back = P.decode(P.encode(d).withColumnRenamed("text", "was"))
    assert back.where("text <> was").count() == 0
    assert P.piece_digest(d).where("round_trip").count() == d.count()


def test_unigram_viterbi_is_the_best_path():
    r = random.Random(1)
    vocab = {p: (i, -r.random() * 5) for i, p in enumerate({"".join(r.choice("▁abc") if k == 0 else r.choice("abc") for k in range(r.randint(1, 3))) for _ in range(25)} - {""}, 256)}
    model = P.PieceModel(vocab, list(range(256)), "unigram")

    def paths(w):
        if not w:
            yield 0.0
        for n in range(1, len(w) + 1):
            if w[:n] in vocab or n == 1:
                for rest in paths(w[n:]):
                    yield rest + (vocab[w[:n]][1] if w[:n] in vocab else model.unknown)

    words = ["▁" + "".join(c) for n in range(1, 6) for c in itertools.product("abc", repeat=n)][:200]
    code = {i.to_bytes(4, "little"): s for i, s in vocab.values()}
    for w, (ids, n, score) in model.encode_words(words).items():
        assert abs(score - max(paths(w))) < 1e-9
        parts = [ids[k : k + 4] for k in range(0, len(ids), 4)]
        byte = [p for p in parts if p not in code]
        unknown = sum(1 for p in byte if int.from_bytes(p, "little") < 128) + sum(1 for p in byte if int.from_bytes(p, "little") == "▁".encode()[0])
        assert abs(sum(code[p] for p in parts if p in code) + model.unknown * unknown - max(paths(w))) < 1e-9


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(P, "WORDS", 3)
    df = spark.createDataFrame([(1, None, 2), (None, "a b c d", 2), (3, "", 2)], "doc_id long, text string, n_ids int")
    got = {r.doc_id: (r.n_ids, r.round_trip) for r in P.piece_digest(df).collect()}
    assert got[1] == got[3] == (0, True) and got[None][0] == 4
    assert P.piece_digest(df.limit(0)).count() == 0 and P.encode(df.limit(0)).count() == 0


def test_long_texts_without_spaces():
    import resource
    import sys

    sp, model, r = sentence_pieces(), P.load_model(), random.Random(8)
    chinese = "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(200_000))
    base64 = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000))
    limit = resource.getrlimit(resource.RLIMIT_AS)
    with open("/proc/self/statm") as f:
        resource.setrlimit(resource.RLIMIT_AS, (int(f.read().split()[0]) * resource.getpagesize() + (2 << 30), limit[1]))
    try:
        codes = [np.frombuffer(c, np.uint32).tolist() for c, _, _ in model.encode([chinese, base64, "a " + chinese[:300] + " b"])]
    finally:
        resource.setrlimit(resource.RLIMIT_AS, limit)
    assert codes == [sp.encode(t) for t in (chinese, base64, "a " + chinese[:300] + " b")]
    assert sum(map(sys.getsizeof, model.words)) < 1 << 28 and max(map(len, model.words)) <= P.LONG
    assert model.decode(codes[0]) == chinese and model.decode(codes[1]) == base64


def best_path(model, word):
    """(score, fewest and most pieces) of the best-scored path of one word, by a table over all pairs of places."""
    best = [(0.0, {0})] + [(-1e18, set())] * len(word)
    for i in range(1, len(word) + 1):
        for a in range(max(0, i - 20), i):
            t = word[a:i]
            score = model.score.get(t, model.unknown if len(t) == 1 else None)
            if score is None or best[a][0] < -1e17:
                continue
            s = best[a][0] + score
            if abs(s - best[i][0]) < 1e-6:
                best[i] = (best[i][0], best[i][1] | {n + 1 for n in best[a][1]})
            elif s > best[i][0]:
                best[i] = (s, {n + 1 for n in best[a][1]})
    return best[-1]


def test_best_scored_paths_of_the_query(spark):
    assert max(map(len, P.load_model().score)) <= 20
    r = random.Random(2)
    texts = [*ODD, *[" ".join("".join(r.choice("abcdeinorst漢é") for _ in range(r.randint(1, 14))) for _ in range(40)) for _ in range(10)]]
    model = P.load_model()
    for x in P.piece_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        words = [m for m in re.findall("▁*[^▁]+|▁+", "▁" + texts[x.doc_id].replace(" ", "▁"))] if texts[x.doc_id] else []
        found = [best_path(model, w) for w in words]
        assert abs(x.best_score - sum(f[0] for f in found)) < 1e-3
        assert sum(min(f[1]) for f in found) <= x.n_best <= sum(max(f[1]) for f in found)
