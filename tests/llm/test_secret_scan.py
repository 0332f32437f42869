import hashlib
import re

from gradelake.llm import license_scan as L
from gradelake.llm import secret_scan as S

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def base_spans(text):
    out = []
    for rank, (kind, rx, group, least) in enumerate(BASE):
        out += [(m.start(), rank, m.end(), kind) for m in rx.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


KEY = "AKIA" + "Q7" * 8
TEXTS = [
    "", None, "nothing here", "é🙂 password = 'hunter22' and token: ab", f"{KEY}{KEY}", "0123456789abcdef01234567api_key=zzzzzz", "Secret=\"a.b/c+d=e\" PASSWD:123456 ApiKey : qwertyu",
    "token=token=abcdef", "x" * 5000 + f" {KEY} " + "f" * 30, f"user: joe_1 " + "y" * 50 + " password=12345678", "user: joe_1 " + "y" * 500 + " password=12345678", "pwd=abcd user=bob1", "pwd=abcd alone",
    f"see https://db.example.com/x {KEY} secret: 0a0a0a0a", "see https://db.example.com/x only", "password=\npassword=abcdef", "password = \"" + "0a" * 20 + "\"",
]


def test_base_spans_and_linked_parts(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, TEXTS[3], "n")]
    got = S.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = base_spans(TEXTS[3 if r.doc_id is None else r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)], r
        joined = [f"{k}:{a}:{b}" for a, _, b, k in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) if joined else True
    kinds = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",") if s} for r in got}
    assert "user" in kinds[9] and "user" not in kinds[10]
    assert kinds[11] == {"phrase", "user"} and kinds[12] == set()
    assert "endpoint" in kinds[13] and kinds[14] == set()
    assert S.secret_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


WEAK = [(kind, role, re.compile(pattern.replace("(?i)", ""), re.I | re.A), group, least) for kind, role, strong, pattern, group, least in S.KINDS if not strong or role]
LINKED = [
    "login: ann pwd=abcd", "login: ann\n\npwd=abcd", "login: ann\n \t\npwd=abcd", "login: ann\npwd=abcd", "login: ann see http://a.example.org and pwd=abcd", "http://a.example.org login: ann",
    "login: ann " + "x" * 190 + " http://a.example.org " + "y" * 190 + " pwd=abcd", "login: ann " + "x" * 300 + " http://a.example.org " + "y" * 190 + " pwd=abcd", "user: maria, commit " + "0a" * 20,
    "user: maria, commit " + "0a" * 20 + " " + "z" * 170 + " signature=zzzz", "login: ann " + "token=abcdefgh " * 3 + "\n\nhttp://b.example.org/ pwd=abcd client_id=12345",
]


def linked(text):
    """Kinds and places of the weak parts that are reported: scopes by comparing every part with all before it."""
    parts = []
    for kind, role, rx, group, least in WEAK:
        parts += [(m.start(), m.end(), role, kind) for m in rx.finditer(text) if len(m[group]) >= least]
    parts.sort()
    scopes = []
    for p in parts:
        reach = [q for s in scopes[-1:] for q in s if p[0] <= q[1] + S.REACH]
        if reach and not re.search(r"\n[ \t\r]*\n", text[scopes[-1][0][0] : p[0]]):
            scopes[-1].append(p)
        else:
            scopes.append([p])
    strong = {k[0] for k in S.KINDS if k[2]}
    return sorted((p[3], p[0], p[1]) for s in scopes if {"identifier", "secret"} <= {q[2] for q in s} for p in s if p[3] not in strong)


def test_parts_of_a_credential_stand_or_fall_together(spark):
    texts = [t for t in LINKED + TEXTS if t]
    got = {r.doc_id: r.spans for r in S.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    some = 0
    for i, t in enumerate(texts):
        spans = [x.split(":") for x in got[i].split(",") if x]
        want = linked(t)
        some += len(want)
        assert sorted((k, int(a), int(b)) for k, a, b in spans if k in ("user", "phrase", "endpoint")) == want, t
    assert some > 15 and got[8].startswith("hex") and linked(LINKED[1]) == []


def test_many_parts_in_one_document_cost_a_sort(spark):
    text = "".join(f"user: name{i} pwd=secret{i} " for i in range(100_000))
    row = S.secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_linked == 200_000


def test_redaction(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, cuts int")
    out = S.redact(df)
    assert out.columns == df.columns
    for r in out.collect():
        text = TEXTS[r.doc_id]
        spans = base_spans(text)
        if not spans and r.doc_id not in (11,):
            assert r.text == text
        else:
            assert S.MASK in r.text and not any(text[a:b] in r.text for a, _, b, _ in spans)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[3] == "é🙂 [redacted]' and token: ab" and got[5] == "[redacted]"


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\nThe software is provided \"as is\", without warranty of any kind, express or implied."
    rows = [(1, "Licensed under the Apache License, Version 2.0.\ntext", 1), (2, f"Released under the MIT License.\nfoo\n{mit}", 1), (3, mit.split("\n")[0], 1), (4, None, 1), (5, "All rights reserved! Released under the MIT License", 1), (5, "", 1)]
    got = [(r.doc_id, r.n_sentences, r.licenses) for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()]
    assert sorted(got) == [(1, 1, "Apache-2.0"), (2, 3, "MIT"), (3, 1, ""), (4, 0, ""), (5, 0, ""), (5, 2, "MIT,All-rights-reserved")]
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
