import random

from factweave.llm import token_counts, tokens

MODEL = tokens.public_vocabulary()
ODD = ["", " ", "  ", "a ", " a", "a  b   c ", "\n\n", "▁▁a▁", "é中😀\x00", "<s></s><0x0A>", "x" * 500, "中" * 300, "ab " * 400, " " * 333, "😀" * 200]


def drawn(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab the ing  \n\t▁é中😀<0x0A> ſ!?.,") for _ in range(rng.randint(0, 400))) for _ in range(n)]


def test_memo_equals_library():
    encoder = tokens.load(MODEL)
    texts = ODD + drawn(300)
    assert encoder.separable
    assert [list(x) for x in encoder.ids(texts)] == encoder.library.encode(texts)


def test_memo_forgets_but_stays_right():
    encoder = tokens.SentencePieceTokens(MODEL, limit=5)
    texts = drawn(200, 4)
    assert [list(x) for x in encoder.ids(texts)] == encoder.library.encode(texts)


def test_chunks_equal_library():
    encoder = tokens.load(MODEL)
    for text in ODD + drawn(200, 5):
        for chunk, overlap in ((7, 1), (40, 3), (64, 16)):
            assert list(token_counts.encode_chunks(encoder, text, chunk, overlap)) == encoder.library.encode(text)


def test_rows(spark):
    rows = [(1, "a b c", 9), (1, "a b c", 9), (None, None, 1), (2, "", None), (3, "the " * 9000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(token_counts.count_tokens(docs, MODEL).collect(), key=str)
    library = tokens.load(MODEL).library
    want = [(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t, _ in rows]
    assert sorted([tuple(r)[:3] for r in got], key=str) == sorted(want, key=str)
    assert [r.over_limit for r in got if r.doc_id == 3] == [True]
    assert token_counts.count_tokens(docs.limit(0), MODEL).count() == 0
