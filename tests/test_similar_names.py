"""Similar names in parts of their blocks."""

import random

from folioscope.operators import author_ids as aid


def test_parts_of_blocks_give_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    names = sorted({"TO" + "".join(rng.choice("ABCD") for _ in range(rng.randint(0, 6))) for _ in range(150)} | {"XY", "ZZ TOP", "ZZ TOPP"})
    df = spark.createDataFrame([(x,) for x in names], "name string")
    w = {}
    for r in aid.trigram_weights(df).collect():
        w.setdefault((r.block, r.name), {})[r.gram] = r.w
    want = {}
    for (p, a), x in w.items():
        for (q, b), y in w.items():
            s = sum(v * y.get(g, 0.0) for g, v in x.items())
            if p == q and a < b and s > 0.6:
                want[p, a, b] = round(s, 9)
    for together, cells in ((4_000, 1 << 20), (20, 40)):
        monkeypatch.setattr(aid, "NAMES_TOGETHER", together)
        monkeypatch.setattr(aid, "CELLS", cells)
        rows = aid.similar_names(df, 0.6).collect()
        assert {(r.block, r.a, r.b): round(r.similarity, 9) for r in rows} == want and len(rows) == len(want) > 10
    assert aid.similar_names(df.limit(0), 0.6).count() == 0


def test_pairs_that_share_a_trigram_are_no_rows(spark):
    """No join by trigram: only names meet, in parts."""
    df = spark.createDataFrame([("TORRES ANN",), ("TORRES BEN",)], "name string")
    plan = aid.similar_names(df, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and not [x for x in plan.splitlines() if "Join" in x and "gram" in x]
