"""Token counts of texts of any length: overlapping chunks, spliced where both sides provably agree.

Why a splice is exact. In a merge encoding, a sequence of tokens is the encoding of its text if and only if each two adjacent
tokens are the encoding of their own text: up to the first merge across a boundary, each side merges just as it does alone.
So two chunk encodings may be joined at a common boundary p if the token before p, or the token after p, is the same in both:
each pair of the joined sequence is then a pair of one of the two encodings. Where an overlap has no such boundary, it is doubled,
at last up to the start of the text. The library encodes each chunk; memory is bounded by the chunk, not by the text.

Rows: null texts count as empty (0 tokens), repeated rows and ids keep one result each, other columns pass through `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm import tokens
from factweave.llm.common import carried, text_or_empty

CHUNK = 16_384  # code points that are encoded at a time
OVERLAP = 256  # of them again, at first
LIMIT = 4096


def _with_ends(encoder, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of text[start:end], the offset at which each ends, and whether a boundary follows it (not within a character)."""
    ids = encoder.ids([text[start:end]])[0]
    width = encoder.chars[ids]
    inside = np.append(width[1:] == 0, False) if len(ids) else np.zeros(0, bool)
    return ids, start - 1 + np.cumsum(width), ~inside  # the space mark put in front takes up the first character


def splice(left, right) -> tuple[int, int] | None:
    """The last common boundary that is proven: counts of left tokens before it and of right tokens before it."""
    (a, a_end, a_ok), (b, b_end, b_ok) = left, right
    i, j = np.flatnonzero(a_ok[:-1]), np.flatnonzero(b_ok[:-1])
    _, x, y = np.intersect1d(a_end[i], b_end[j], assume_unique=False, return_indices=True)
    i, j = i[x], j[y]
    same = np.flatnonzero((a[i] == b[j]) | (a[i + 1] == b[j + 1]))
    return (int(i[same[-1]]) + 1, int(j[same[-1]]) + 1) if len(same) else None


def encode_chunks(encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of a text as the library gives them, from chunks of it."""
    if len(text) <= chunk:
        return encoder.ids([text])[0]
    parts: list[tuple] = []  # (offset, encoding) up to what is held
    begin, end, held = 0, chunk, _with_ends(encoder, text, 0, chunk)
    while end < len(text):
        stop, wide = min(len(text), end + chunk), overlap
        while True:
            start = max(0, end - wide)
            while parts and begin > start:
                begin, before = parts.pop()
                held = tuple(map(np.concatenate, zip(before, held)))
            fresh = _with_ends(encoder, text, start, stop)
            if start == 0:
                held = fresh
                break
            if at := splice(held, fresh):
                parts.append((begin, tuple(x[: at[0]] for x in held)))
                begin, held = int(fresh[1][at[1] - 1]), tuple(x[at[1] :] for x in fresh)
                break
            wide *= 2
        end = stop
    return np.concatenate([x[0] for _, x in parts] + [held[0]])


def token_count(text: Column, model: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = tokens.load(model)
        for batch in batches:
            texts = batch.tolist()
            short = [i for i, x in enumerate(texts) if len(x) <= chunk]
            n = np.zeros(len(texts), "int64")
            n[short] = list(map(len, encoder.ids([texts[i] for i in short])))
            for i in set(range(len(texts))).difference(short):
                n[i] = len(encode_chunks(encoder, texts[i], chunk, overlap))
            yield pd.Series(n)

    return count(text)


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (doc_id alone unless named), n_bytes, n_tokens and over_limit of each row."""
    row, columns = carried(keep, "n_bytes", "n_tokens", "over_limit")
    out = docs.select(row, text_or_empty().alias("_text"))
    out = out.select(*columns, F.octet_length("_text").cast("bigint").alias("n_bytes"), token_count(F.col("_text"), model, chunk, overlap).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
