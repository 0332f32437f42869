import random
from types import SimpleNamespace

import pytest

from gradelake.llm.common import Scratch, components, free_name
from gradelake.sources.shared import shared_dir


def test_components_against_union_find(spark):
    for seed in range(3):
        r = random.Random(seed)
        edges = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                parent[max(root(a), root(b))] = min(root(a), root(b))
        want = {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
        got = components(Scratch(spark, "t"), spark.createDataFrame([*edges, (None, 3)], "a long, b long"))
        assert {x.id: x.comp for x in got.collect()} == want
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_chain_settles(spark):
    got = components(Scratch(spark, "t"), spark.range(400).selectExpr("id as a", "id + 1 as b"), max_rounds=20).collect()
    assert len(got) == 401 and {x.comp for x in got} == {0}


def test_cluster_without_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://head:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        shared_dir(session)


def test_free_name(spark):
    assert free_name(spark.createDataFrame([], "Key int, key_ int"), "key") == "key__"
