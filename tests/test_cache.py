"""A second run reads only what has changed, and gives what reading all of it would."""

import hashlib

from pyspark.sql import functions as F

from factweave.operators import cache, extract


def test_only_changed_contents_are_read(spark, tmp_path):
    read = []

    def parse(files):
        read.append(files.count())
        return extract.lines(files).where("text <> ''").select("path", "line", "text")

    table = lambda d: spark.createDataFrame(list(d.items()), "path string, content string").withColumn("content", F.encode("content", "UTF-8"))
    whole = lambda d: sorted((p, i + 1, t) for p, s in d.items() for i, t in enumerate((s or "").split("\n")) if t)
    store = str(tmp_path / "store")
    first = {"a": "1\n2", "b": "3", "copy": "3", "empty": "", "none": None}
    second = {"a": "1\n2\nmore", "b": "3", "moved": "1\n2", "empty": ""}
    steps = [(first, 1, 3, {"a", "b", "copy", "empty", "none"}), (first, 1, 0, set()), (second, 1, 1, {"a"}), (second, 2, 4, {"a", "b", "moved", "empty"})]
    # Rows of a run that was broken off before its marks were written.
    lost = spark.createDataFrame([("0" * 64, 1, "x", "lines", 1, "lost"), (hashlib.sha256(b"3").hexdigest(), 1, "3", "lines", 1, "lost")], "digest string, line int, text string, rule string, version int, attempt string")
    lost.write.parquet(f"{store}/rows")
    for n, (files, version, contents, fresh) in enumerate(steps):
        rows, state = cache.kept_up(table(files), store, "lines", version, parse, n)
        assert sorted((r.path, r.line, r.text) for r in rows.collect()) == whole(files)
        assert read[-1] == contents and {r.path for r in state.collect() if r.fresh} == fresh
    # What changed while it was read is given but not kept.
    changing = {"a": "before"}
    rows, _ = cache.kept_up(table(changing), store, "lines", 1, parse, 9, table({"a": "after"}))
    assert rows.count() == 1 and cache.kept_up(table(changing), store, "lines", 1, parse, 10)[0].count() == 1 and read[-2:] == [1, 1]
    cache.swept(store, str(tmp_path / "small"), table(second).select(F.sha2("content", 256).alias("digest")))
    rows, _ = cache.kept_up(table(second), str(tmp_path / "small"), "lines", 1, parse)
    assert read[-1] == 0 and sorted((r.path, r.line, r.text) for r in rows.collect()) == whole(second)
