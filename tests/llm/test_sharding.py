from __future__ import annotations

from collections import Counter

import pytest
from compare import differences

from lectern.llm import queries
from lectern.llm import sharding as H


def test_table_by_turns():
    names, size = H.shard_names(5), 101
    table = H.lookup_table(names, size)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    import hashlib

    orders = []
    for name in names:
        d = hashlib.md5(name.encode()).hexdigest()
        start, stride = int(d[:15], 16) % size, int(d[16:31], 16) % (size - 1) + 1
        orders.append([(start + k * stride) % size for k in range(size)])
        assert sorted(orders[-1]) == list(range(size))
    owner = {}
    turn = 0
    while len(owner) < size:
        owner[next(s for s in orders[turn % 5] if s not in owner)] = turn % 5
        turn += 1
    assert table == tuple(owner[s] for s in range(size))


def test_few_slots_move():
    one, two = (H.lookup_table(H.shard_names(n), 65_537) for n in (64, 65))
    assert sum(a != b for a, b in zip(one, two, strict=True)) < 0.06 * 65_537


def test_same_rows_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.queries()["op9_shard"](spark, sf), queries.oracle_sql()["op9_shard"], sf) == ""


def test_hard_keys_and_files(spark, make, tmp_path):
    docs = make([(None, "a"), (1, "b"), (1, "c"), (2**62, None)])
    out = H.place(docs, "doc_id").collect()
    assert len(out) == 4 and all(0 <= r["shard"] < 64 for r in out) and len({r["shard"] for r in out if r["doc_id"] == 1}) == 1
    assert H.place(make([]), "doc_id").count() == 0
    H.write_shards(spark.range(1000), "id", str(tmp_path / "out"), n_shards=4, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1000 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    for n, size in ((3, 100), (3, 2), (0, 7)):
        with pytest.raises(ValueError):
            H.lookup_table(H.shard_names(n), size)


def test_plan_is_native(spark):
    plan = H.place(spark.range(10), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Exchange hashpartitioning" not in plan
