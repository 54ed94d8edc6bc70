"""Quality rules: how a public vocabulary takes to a text, beside plain counts of words, lines and repeats.

Measured for each whole text: characters per token, the share of tokens that are fallback bytes, and the entropy of its tokens
in bits. Each has a band by language; a text of another or no language takes the band of the script of most of its letters, if there is one.
The fewer tokens a text has, the more its figures are chance, so a band is as wide as WIDTH standard errors of n tokens, and a text of n tokens is expected to have the
entropy of n draws, -log2(1 / n + 1 / kinds). No text is exempt for being short: an English one with the 25 tokens of ten words fails with less than 1.5 characters a
token, with four bytes or more, or with an entropy below 3.4 bits. Scripts other than Latin have no labelled texts to take a band from, so the method keeps their texts.

Rows: a null text has no words and fails the base rule; an empty one too. A null language is unknown. Repeated rows and ids keep
one result each; other columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm import tokens
from factweave.llm.common import carried, let_go, text_or_empty

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"
WHOLE = 2**63


class Band(NamedTuple):
    """What is typical: characters per token, share of bytes, and how many kinds of tokens there seem to be."""

    chars: float
    byte_share: float
    kinds: float


# Means over texts labelled good with even ids, cut to 10, 15, 20, 30, 50, 80, 150 and 400 words and weighted by their tokens. That of the script has the loosest of the four languages'.
BANDS = {
    "en": Band(2.63, 0.0102, 116),
    "de": Band(2.62, 0.0089, 103),
    "es": Band(2.29, 0.0085, 103),
    "fr": Band(2.35, 0.0092, 98),
    "latin": Band(2.29, 0.0102, 98),
}
MOST_CHARS = 8.0  # ordinary prose takes 3 to 5 characters a token where its words are known
WIDTH = 5.0
# Standard errors of the three figures: times 1 / sqrt(n), as those texts have, and of texts as a whole.
ERRORS = {"chars": (1.12, 0.03), "byte_share": (0.12, 0.002), "entropy": (0.95, 0.03)}

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string"
)


def script_of(text: str) -> str:
    """The script of most letters beyond ASCII signs, by code block."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    found = {
        "latin": ((points | 32) - 97 < 26).sum() + ((points >= 0xC0) & (points < 0x250)).sum(),
        "cyrillic": ((points >= 0x400) & (points < 0x530)).sum(),
        "cjk": ((points >= 0x2E80) & (points < 0xA000) | (points >= 0xAC00) & (points < 0xD7B0)).sum(),
    }
    found["other"] = (points >= 0xC0).sum() - found["cyrillic"] - found["cjk"] - ((points >= 0xC0) & (points < 0x250)).sum()
    return max(found, key=found.get)


def repeated_words(words: list) -> int:
    """Words that lie in a window of five which occurs twice or more, its first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict = {}
    code = np.fromiter((seen.setdefault(w, len(seen)) for w in words), "int64", len(words))
    base = len(seen)
    window = code[:n]
    for k in range(1, WINDOW):  # exact: renumbered before a code could pass 63 bits
        if (int(window.max()) + 1) * base >= WHOLE:
            window = np.unique(window, return_inverse=True)[1]
        window = window * base + code[k : n + k]
    order = np.sort(window)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, which, count = np.unique(window, return_inverse=True, return_counts=True)
    hit = count[which] > 1
    edge = np.zeros(len(words) + 1, "int64")
    edge[:n] += hit
    edge[WINDOW : n + WINDOW] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def measures(text: Column, language: Column, model: str) -> Column:
    @F.pandas_udf(MEASURES)
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        let_go(tokens.load)
        encoder = tokens.load(model)
        for texts, languages in batches:
            texts, rows = texts.tolist(), []
            for i in range(0, len(texts), tokens.BLOCK):
                block = texts[i : i + tokens.BLOCK]
                for t, lang, ids in zip(block, languages[i : i + tokens.BLOCK], encoder.ids(block)):
                    words = t.encode().split()  # bytes split at the six ASCII spaces alone
                    share = np.unique(ids, return_counts=True)[1] / max(1, len(ids))
                    rows.append(
                        (
                            len(words),
                            len(t) - sum(map(t.count, SPACE)),
                            sum(map(t.count, SYMBOLS)),
                            duplicate_lines(t),
                            repeated_words(words),
                            len(ids),
                            len(t) / len(ids) if len(ids) else 0.0,
                            float(encoder.is_byte[ids].mean()) if len(ids) else 0.0,
                            float(-(share * np.log2(share)).sum()) + 0.0,
                            lang if lang in BANDS else script_of(t),
                        )
                    )
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in MEASURES.split(", ")])

    return measure(text, language)


def in_band(m: str, bands: dict[str, Band] = BANDS, width: float = WIDTH) -> Column:
    """Whether the measures in struct column m lie within the band of their language or script, as wide as their number of tokens asks for; true where there is none."""
    n = F.greatest(F.col(f"{m}.n_tokens"), F.lit(1)).cast("double")
    room = {name: width * F.sqrt(each * each / n + whole * whole) for name, (each, whole) in ERRORS.items()}
    within = F.lit(True)
    for name, b in bands.items():
        chars = F.col(f"{m}.chars_per_token").between(b.chars - room["chars"], MOST_CHARS)
        fits = chars & (F.col(f"{m}.byte_share") <= b.byte_share + room["byte_share"]) & (F.col(f"{m}.token_entropy") >= -F.log2(1 / n + 1 / b.kinds) - room["entropy"])
        within = F.when(F.col(f"{m}.script") == name, fits).otherwise(within)
    return within


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * F.col(f"{m}.n_words"))


def quality(docs: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (doc_id alone unless named), the measures, base_failed and kept of every row."""
    row, columns = carried(keep, *(x.split()[0] for x in MEASURES.split(", ")), "base_failed", "kept")
    out = docs.select(row, measures(text_or_empty(), F.coalesce(F.col("lang"), F.lit("")), model).alias("_m"))
    out = out.withColumn("_failed", base_failed("_m"))
    return out.select(*columns, "_m.*", F.col("_failed").alias("base_failed"), (~F.col("_failed") & in_band("_m")).alias("kept"))
