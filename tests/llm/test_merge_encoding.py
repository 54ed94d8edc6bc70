import hashlib

from pyspark.sql import functions as F
from test_token_counts import MODEL, ODD, drawn

import corpus_pipeline
from factweave.llm import merge_encoding, tokens


def test_encode_and_decode_equal_library():
    encoder, library = merge_encoding.load(MODEL), tokens.load(MODEL).library
    for text in ODD + drawn(1500, 6) + ["Verschwiegenheitspflichten undünßgeheiten", "tha" * 300, "aaaa" * 111, "====" * 50 + "\t\t"]:
        ids = library.encode(text)
        assert encoder.encode(text) == ids
        assert encoder.decode(ids) == library.decode(ids), text


def test_decode_of_any_ids():
    encoder, library = merge_encoding.load(MODEL), tokens.load(MODEL).library
    for ids in ([3 + 0xE4, 3 + 0xB8, 500], [3 + 0xFF, 3 + 0x41], [1, 450, 2], [3 + 0x80, 3 + 0x80, 3 + 0xE4, 3 + 0xB8, 3 + 0xAD]):
        assert encoder.decode(ids) == library.decode(ids)


def test_backtracking_is_needed_and_failed_positions_are_marked():
    encoder = merge_encoding.load(MODEL)
    words = [w for t in drawn(400, 7) for w in t.split()]
    greedy_differs = 0
    for w in set(words):
        if all(c in encoder.id_of for c in w):
            ids = encoder.stretch(w)
            assert "".join(encoder.pieces[i] for i in ids) == w and [encoder.pieces[i] for i in ids] == encoder.remerge(w)
            greedy_differs += max(p for p in range(1, len(w) + 1) if w[:p] in encoder.id_of) != len(encoder.pieces[ids[0]])
    assert greedy_differs > 0


def test_rows(spark):
    rows = [(1, "ab c", "x"), (1, "ab c", "x"), (None, None, None), (2, "", ""), (3, "the é " * 4000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = merge_encoding.encode_documents(docs, MODEL).collect()
    library = tokens.load(MODEL).library
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(d, len(i := library.encode(t or "")), sha(",".join(map(str, i))), sha(library.decode(i))) for d, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert merge_encoding.encode_documents(docs.limit(0), MODEL).count() == 0
    back = docs.select(merge_encoding.decoded(merge_encoding.token_ids(docs.text, MODEL), MODEL).alias("t")).where("text is not null")
    assert [r.t for r in back.collect()] == [t for _, t, _ in rows if t is not None]


def test_tokens_and_the_text_they_give_are_results(spark):
    rows = [(1, "ab c"), (1, "ab c"), (None, None), (2, ""), (3, " the é 中 x " * 300), (4, "x\ty\nz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = merge_encoding.encode_tokens(docs, MODEL)
    assert out.columns == ["doc_id", "ids", "decoded"]
    library = tokens.load(MODEL).library
    want = [(d, library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t in rows]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    # The text is read from the ids alone: other ids give another text.
    other = out.where("doc_id = 1").limit(1).select(merge_encoding.decoded(F.slice("ids", 1, 1), MODEL).alias("t")).first()
    assert other.t == library.decode(library.encode("ab c")[:1])


def test_pipeline_ends_in_tokens(spark):
    docs = spark.createDataFrame([(1, "ab c", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    row = corpus_pipeline.STAGES[-1][1](spark, docs, "").first()
    assert row.ids == tokens.load(MODEL).library.encode("ab c") and row.decoded == "ab c" and row.n_tokens == len(row.ids)


def test_a_long_text_without_spaces():
    encoder, library = merge_encoding.load(MODEL), tokens.load(MODEL).library
    text = "".join(drawn(3000, 8)).replace(" ", "")[:60_000]
    assert len(text) > 20_000 and encoder.encode(text) == library.encode(text)


def test_null_ids(spark):
    ids = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.t for r in ids.select(merge_encoding.decoded(F.col("ids"), MODEL).alias("t")).collect()] == [None, ""]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "ab c", "x", "y")], "doc_id long, text string, ids string, n_tokens string")
    assert merge_encoding.encode_tokens(docs, MODEL, ["doc_id", "ids"]).columns == ["doc_id", "ids_in", "ids", "decoded"]
    row = merge_encoding.encode_documents(docs, MODEL, ["doc_id", "n_tokens", "ids"]).first()
    assert (row.n_tokens_in, row.ids, row.n_tokens) == ("y", "x", len(tokens.load(MODEL).library.encode("ab c")))


def test_known_pairs_are_not_asked_for_again(monkeypatch):
    encoder = merge_encoding.MergeEncoder(tokens.public_vocabulary())
    want = encoder.encode("several unremarkable words, ünwritten")
    asked = []
    monkeypatch.setattr(encoder, "compatible", lambda *pair: asked.append(pair))
    encoder.memo.clear()
    assert encoder.encode("several unremarkable words, ünwritten") == want and not asked
