import re
from collections import Counter

import corpus_pipeline as C
from gradelake.llm import quality, secret_scan
from tests.llm.test_minhash_dedup import brute as brute_groups
from tests.llm.test_secret_scan import base_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in C.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
        if name != "packing":
            assert seen[-1].columns == columns, name
    start, good, unique, cut, clean, packed = ({r.doc_id: r for r in d.collect()} for d in seen)
    bad = {r.row.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 0").collect()}
    assert good.keys() == start.keys() - bad
    want = {d for d, _, _, kept in brute_groups([(r.doc_id, r.text) for r in good.values()], 5, 80, 100) if kept}
    assert unique.keys() == want
    assert cut.keys() == unique.keys() == clean.keys()
    times = Counter()
    for r in unique.values():
        b = r.text.encode()
        times.update(b[i : i + 200] for i in range(len(b) - 199))
    for d, r in unique.items():
        b = r.text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if times[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        if not any(gone):
            assert cut[d].text == r.text
        else:
            assert sum(gone) - 8 * 3 <= len(b) - len(cut[d].text.encode()) <= sum(gone)
        assert cut[d].n_chars == len(cut[d].text)
    for d, r in clean.items():
        spans = base_spans(cut[d].text)
        assert (r.text == cut[d].text) == (not spans) or not spans
        assert not [s for s in base_spans(r.text) if "redacted" not in r.text[s[0] : s[2]]]
        assert len(re.findall(re.escape(secret_scan.MASK), r.text)) <= max(1, 3 * len(spans))
    assert packed.keys() == clean.keys()


def test_run_is_the_stages(spark):
    assert C.run(spark, SF).count() >= 1
