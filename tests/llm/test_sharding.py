import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from factweave.llm import sharding


def checked(rows, got, shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows), key=str)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(shards)) and max(counts.values(), default=0) - min(counts.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_small_groups_meet(spark):
    rows = [(i, f"text {i % 1500}" if i < 3000 else f"alone {i}", 1) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(7)
    out = sharding.assign(docs, 10, keep=["doc_id", "text"])
    checked(rows, out.collect(), 10)
    r = sharding.cut_links(out, F.col("text")).first()
    assert r.links == 1500 and r.cut <= 30


def test_hot_group_fills_whole_shards(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"alone {i}", 1) for i in range(9000)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(5), 12, keep=["doc_id", "text"])
    got = out.collect()
    checked(rows, got, 12)
    hot = Counter(r.shard for r in got if r.text == "hot")
    assert sum(n for _, n in hot.most_common(4)) > 0.95 * 3000


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "", "b"), (3, "é" * 70000, None), (3, "é" * 70000, None), (4, "x", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    checked(rows, sharding.assign(docs).collect(), 40)
    checked(rows, sharding.assign(docs, 2).collect(), 2)
    assert sharding.assign(docs.limit(0)).count() == 0


def test_rounds_go_on_while_they_save_cuts(spark):
    """Cuts fall round by round to what the law allows: groups that fit are whole but for the rows that a surplus can't pay back."""
    rows = [(i, f"group {i % 400}" if i < 4000 else f"alone {i}") for i in range(5000)]
    cuts = []
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 10, keep=["doc_id", "text"], cuts=cuts)
    assert cuts[0] > cuts[1] and all(a > b for a, b in zip(cuts[:-2], cuts[1:-1])) and (cuts[-1] == 0 or cuts[-1] >= cuts[-2])
    shards = defaultdict(Counter)
    for r in out.collect():
        shards[r.text][r.shard] += 1
    plain = sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in shards.values())
    assert plain == min(cuts) == sharding.cut_links(out, F.col("text")).first().cut
