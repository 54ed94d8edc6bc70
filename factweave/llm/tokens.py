"""Token ids of whole texts from a sentencepiece model, with a bounded memo of word segments.

A text is cut before every run of spaces. The cut is exact where no piece of the vocabulary holds another character before a
space mark, for then no merge can cross it; load() proves that over the whole vocabulary and encodes whole texts otherwise.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np

from factweave.llm.common import loader

MARK = "▁"
MEMO = 250_000  # segments kept in each of two generations
BLOCK = 64  # texts looked up together

_runs = re.compile(" +[^ ]*")


class Memo(dict):
    """A dictionary that makes missing values in batches and forgets what has not been used lately."""

    def __init__(self, make, limit: int = MEMO):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def learn(self, lists: list[list[str]]) -> None:
        """Make the values of all keys in lists present until the next call."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        missing = []
        for k in set(chain.from_iterable(lists)).difference(self):
            if k in self.old:
                self[k] = self.old[k]
            else:
                missing.append(k)
        self.update(zip(missing, self.make(missing)))


def segments(text: str) -> list[str]:
    """The parts between possible merges, each without the one space mark that starts it. Empty texts have none."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" in words:
        return [x[1:] for x in _runs.findall(" " + text.replace(MARK, " "))]
    return words


class SentencePieceTokens:
    """ids(texts) as the library gives them, as arrays of unsigned 32-bit numbers."""

    def __init__(self, path: str, limit: int = MEMO):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.is_byte = np.array([self.library.is_byte(i) for i in range(n)])
        # Characters that a token takes up; a character that falls back to bytes counts with its first byte.
        self.chars = np.array([(0 if "<0x80>" <= p <= "<0xBF>" else 1) if b else len(p) for p, b in zip(pieces, self.is_byte)], "int64")
        plain = [p for i, p in enumerate(pieces) if not (self.is_byte[i] or self.library.is_control(i) or self.library.is_unknown(i))]
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain) and self.library.normalize(" a  b ") == "▁▁a▁▁b▁"
        self.memo = Memo(self._encode_segments, limit)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.library.encode(texts, num_threads=1)]

    def _encode_segments(self, parts: list[str]) -> list[bytes]:
        """An empty segment is a space mark alone; the library makes nothing of an empty text."""
        lone = array("I", [self.library.piece_to_id(MARK)]).tobytes()
        return [x if p else lone for p, x in zip(parts, self._encode(parts))]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.separable:
            return [np.frombuffer(x, "u4") for x in self._encode(texts)]
        out = []
        for i in range(0, len(texts), BLOCK):
            lists = [segments(x) for x in texts[i : i + BLOCK]]
            self.memo.learn(lists)
            out += [np.frombuffer(b"".join(map(self.memo.__getitem__, x)), "u4") for x in lists]
        return out


@loader
@lru_cache(maxsize=4)
def load(path: str) -> SentencePieceTokens:
    """One encoder for each model and Python worker."""
    return SentencePieceTokens(path)


def public_vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
