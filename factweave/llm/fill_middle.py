"""Fill-in-middle: documents cut at two random token borders, their middle moved to the end behind marks.

Tokens are the isolated matches of a pattern by the tokenizers library's Split pre-tokenizer, which needs no vocabulary: its offsets are code points, the length of the
array of offsets is n, and the offsets of two random ranks are where the text is cut. Long texts are matched block by block, cut where a match must end, and
of each token one number is held. The library sees texts in tasks only; drawing, cutting, moving and putting together again are column expressions.

Rows: a null text counts as empty, and an empty one stays plain. A null id draws as the empty string. Rows of the same id and text come out alike. Repeated rows keep a
result each; columns keep go through, one with the name of a result as <name>_in. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import carried, text_or_empty, uncollected

PATTERN = "[A-Za-z]+|[^A-Za-z]"
BORDER = "[^A-Za-z]"  # a match begins at each of these
MARKS = ("<P>", "<S>", "<M>")
BLOCK = 1 << 15  # code points given to the library at a time, and on to the next border
SEED = 1
MOVED = 90  # of 100 texts
SUFFIX_FIRST = 20  # of 100 of those


@lru_cache(maxsize=4)
def splitter(pattern: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), behavior="isolated").pre_tokenize_str


def offsets(text: str, pattern: str = PATTERN, border: str = BORDER, block: int = BLOCK) -> np.ndarray:
    """Where each token begins, in code points, and where the last ends. Every character that matches border must begin a match."""
    split, at, parts, find = splitter(pattern), 0, [], re.compile(border).search
    while at < len(text):
        cut = find(text, at + block)
        end = cut.start() if cut else len(text)
        parts.append(np.fromiter((o[0] for _, o in split(text[at:end])), "i8") + at)
        at = end
    return np.concatenate([*parts, [len(text)]]).astype("i8")


def placed(text: str, one: int, two: int, pattern: str = PATTERN, border: str = BORDER, block: int = BLOCK) -> tuple[int, int, int]:
    """n, the number of tokens, and the offsets at the smaller and the larger of the ranks one % (n + 1) and two % (n + 1). Of a text of one block only these two are looked up."""
    if 0 < len(text) <= block:
        found = splitter(pattern)(text)
        n, at = len(found), lambda rank: found[rank][1][0] if rank < len(found) else len(text)
    else:
        every = offsets(text, pattern, border, block)
        n, at = len(every) - 1, lambda rank: int(every[rank])
    x, y = sorted((one % (n + 1), two % (n + 1)))
    return n, at(x), at(y)


CUTS = "n long, first long, second long"


def cuts(text: Column, one: Column, two: Column, pattern: str = PATTERN, border: str = BORDER) -> Column:
    """Struct of n, the number of tokens, and of the offsets at the smaller and the larger of the ranks one % (n + 1) and two % (n + 1)."""

    @F.pandas_udf(CUTS)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, a, b in batches:
            with uncollected():
                out = [placed(t, x, y, pattern, border) for t, x, y in zip(texts, a.tolist(), b.tolist())]
            yield pd.DataFrame(np.array(out, "i8").reshape(-1, 3), columns=["n", "first", "second"])

    return cut(text, one, two)


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers that follow from the seed and the key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which an output of a form was made. No text that holds a mark is moved, so each mark of a moved one is found once."""
    part = F.split(output, "|".join(map(re.escape, marks)), -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_middle(docs: DataFrame, key: str = "doc_id", keep: list[str] | None = None, seed: int = SEED, moved: int = MOVED, suffix_first: int = SUFFIX_FIRST, pattern: str = PATTERN, border: str = BORDER, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Columns keep (doc_id alone unless named), n (tokens), form, prefix_chars, middle_chars (null if plain) and output, the text to train on, of every row.

    Form is plain if the text is empty or holds a mark, else for 100 - moved of 100 draws; of the others suffix_first of 100 are spm, the rest psm.
    """
    row, columns = carried(keep, "n", "form", "prefix_chars", "middle_chars", "output")
    h = draws(F.col(f"`{key}`"), seed)
    rows = docs.select(row, text_or_empty().alias("_t"), *[x.alias(f"_h{k}") for k, x in enumerate(h, 1)])
    rows = rows.withColumn("_c", cuts(F.col("_t"), F.col("_h1"), F.col("_h2"), pattern, border))
    text, first, second = F.col("_t"), F.col("_c.first").cast("int"), F.col("_c.second").cast("int")
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains(text, F.lit(m))
    form = F.when((text == "") | marked | (F.col("_h3") % 100 >= moved), "plain").when(F.col("_h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("_form", form)
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.length(text))
    p, s, m = map(F.lit, marks)
    plain = F.col("_form") == "plain"
    output = F.when(plain, text).when(F.col("_form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return rows.select(*columns, F.col("_c.n").alias("n"), F.col("_form").alias("form"), F.when(~plain, F.col("_c.first")).alias("prefix_chars"), F.when(~plain, F.col("_c.second") - F.col("_c.first")).alias("middle_chars"), output.alias("output"))
