"""Decisions as a stream equal their fold as a table, for any order of arrival and across a restart."""

import random

from factweave.operators import journal
from factweave.streaming import journal as stream

SCHEMA = "type string, target string, at string, line_no long, of string, content_hash string, expires string"


def test_any_arrival_and_a_restart_give_the_fold(spark, tmp_path):
    rng = random.Random(4)
    kinds = ["snooze", "tombstone", "rejection", "waiver"]
    rows = []
    for i in range(240):
        kind = rng.choice([*kinds, "revoke"])
        rows.append((kind, f"t{rng.randint(0, 14)}", f"2024-01-{rng.randint(1, 20):02}", i, rng.choice(kinds) if kind == "revoke" else None, f"h{i}", "2024-02-01" if i % 5 == 0 else None))
    table = spark.createDataFrame(rows, SCHEMA)
    newest = journal.latest(table, ["type", "target"], "at", "line_no")
    want = {tuple(r) for r in journal.effective(newest.where("type <> 'revoke'"), newest.where("type = 'revoke'"), "target", "at", "of").select(*SCHEMA.replace(" string", "").replace(" long", "").split(", ")).collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STORE)
    try:
        late = [*rows, (None, "t1", "2024-01-01", 1, None, None, None), ("snooze", None, "2024-01-01", 1, None, None, None)]
        rng.shuffle(late)
        source = tmp_path / "in"
        log = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        for part in (late[:90], late[90:]):
            for k in range(0, len(part), 45):
                spark.createDataFrame(part[k : k + 45], SCHEMA).coalesce(1).write.mode("append").json(str(source))
            query = stream.follow(log(), str(tmp_path / "table"), str(tmp_path / "checkpoint"))
            query.processAllAvailable()
            query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = stream.standing(spark, str(tmp_path / "table")).select("type", "target", "at", "line_no", "of", "content_hash", "expires")
    assert {tuple(r) for r in got.collect()} == want and 20 < len(want) < 60
    assert {r.expires for r in stream.standing(spark, str(tmp_path / "table"), "2024-03-01").collect()} == {None}
