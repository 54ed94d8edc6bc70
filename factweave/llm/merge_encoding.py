"""SentencePiece encoding by backtracking over longest matches, and decoding.

A token sequence is the merge encoding of a text if and only if each two adjacent tokens are that of their own text (up to the
first merge across a boundary each side merges as it does alone). So it is enough to walk from the left: take the longest token
of the vocabulary that starts here (an Aho-Corasick automaton lists all that do) and is compatible with the token before it,
where two tokens are compatible if merging their joined text again gives just the two. If none is, step back one token and
try its next shorter one; a bit for each position remembers where the rest could not be encoded, so no position is tried twice
and time is linear in the text. Characters outside the vocabulary fall back to bytes.

Rows: null texts count as empty (no tokens), repeated rows and ids keep one result each, other columns pass through. A text without
spaces is one segment, encoded whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import carried, let_go, loader, text_or_empty, uncollected
from factweave.llm.tokens import BLOCK, MARK, Memo, segments

PAIRS = 200_000  # compatibility results kept
WORDS = 120_000  # segments kept in each of two generations


class MergeEncoder:
    """Encoding of segments (texts between space marks), from the pieces and scores of a sentencepiece model."""

    def __init__(self, path: str, limit: int = WORDS):
        import ahocorasick
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [(m.is_byte(i), m.is_control(i) or m.is_unknown(i)) for i in range(m.get_piece_size())]
        self.pieces = [m.id_to_piece(i) for i in range(len(kinds))]
        self.bytes_of = {i: int(self.pieces[i][1:-1], 16) for i, k in enumerate(kinds) if k[0]}
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        self.silent = {i for i, k in enumerate(kinds) if m.is_control(i)}
        self.unknown = m.unk_id()
        self.written = [" ⁇ " if i == self.unknown else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not any(kinds[i])}
        self.score = {p: m.get_score(i) for p, i in self.id_of.items()}
        if any(c not in self.id_of for p in self.id_of for c in p) or any(MARK in p.lstrip(MARK) for p in self.id_of) or m.normalize(" a  b ") != "▁▁a▁▁b▁":
            raise ValueError("the vocabulary has a merge that this encoder does not follow")
        self.size = [len(p) for p in self.pieces]
        self.single = {c: (i,) for c, i in self.id_of.items() if len(c) == 1}
        self.known = frozenset(self.single)
        raw = [b"" if i in self.silent else bytes([self.bytes_of[i]]) if i in self.bytes_of else w.encode() for i, w in enumerate(self.written)]
        self.width = np.array([len(x) for x in raw])
        self.place = np.cumsum(self.width) - self.width
        self.blob = np.frombuffer(b"".join(raw), "u1")
        self.marked = np.array([p.startswith(MARK) for p in self.pieces], "i8")
        self.high = np.array([self.bytes_of.get(i, 0) > 127 for i in range(len(raw))])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, i in self.id_of.items():
            if len(p) > 1:  # single characters need no search
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}  # by left * vocabulary + right
        self.memo = Memo(self._learn, limit)

    def remerge(self, text: str) -> list[str]:
        """Merge from single characters, the best score first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """left -1: the start of a stretch, where the token must only be the encoding of its own text."""
        key = left * len(self.pieces) + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            want = [self.pieces[right]] if left < 0 else [self.pieces[left], self.pieces[right]]
            known = self.pairs[key] = self.remerge("".join(want)) == want
        return known

    def stretch(self, text: str) -> list[int]:
        """Encode a text all of whose characters are in the vocabulary."""
        size, compatible, seen, wide = self.size, self.compatible, self.pairs.get, len(self.pieces)
        starts = list(map(self.single.__getitem__, text))
        for end, token in self.automaton.iter(text):
            starts[end - size[token] + 1] += (token,)  # shorter ones come first
        failed = 0  # bit p: the text from p on can't be encoded after what may stand before it
        out: list[int] = []
        tried: list[int] = []  # of each token in out, its place among those that start there
        at, last, k, n = 0, -1, len(starts[0]) - 1, len(text)
        while at < n:
            here = starts[at]
            while k >= 0:
                token = here[k]
                if not (failed and failed >> at + size[token] & 1):
                    fits = seen(last * wide + token)
                    if compatible(last, token) if fits is None else fits:
                        break
                k -= 1
            if k >= 0:
                out.append(token)
                tried.append(k)
                at, last = at + size[token], token
                k = len(starts[at]) - 1 if at < n else 0
            else:
                if not out:
                    raise ValueError("a text has no encoding")
                failed |= 1 << at
                k = tried.pop() - 1
                at -= size[out.pop()]
                last = out[-1] if out else -1
        return out

    def segment(self, text: str) -> list[int]:
        """Ids of a text with its space marks; a character outside the vocabulary becomes its bytes."""
        if text and self.known.issuperset(text):
            return self.stretch(text)
        out, begin = [], 0
        for i, c in enumerate(text):
            if c not in self.known:
                if i > begin:
                    out += self.stretch(text[begin:i])
                out += [self.byte_id.get(b, self.unknown) for b in c.encode("utf-8", "surrogatepass")]
                begin = i + 1
        return out + self.stretch(text[begin:]) if begin < len(text) else out

    def _learn(self, parts: list[str]) -> list[bytes]:
        """The ids of each segment, as bytes of 32-bit numbers."""
        return [array("i", self.segment(MARK + p.replace(" ", MARK))).tobytes() for p in parts]

    def joined(self, ids: list[int]) -> str:
        """The text of ids, each space mark as a space; bytes that form no character as the replacement sign."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(_characters(bytes(run)))
                run.clear()
            if i not in self.silent:
                out.append(self.written[i])
        return "".join(out) + _characters(bytes(run))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of 32-bit numbers."""
        out = []
        for i in range(0, len(texts), BLOCK):
            lists = [segments(x) for x in texts[i : i + BLOCK]]
            self.memo.learn(lists)
            out += [b"".join(map(self.memo.__getitem__, x)) for x in lists]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Back to text, without the space mark that encoding puts in front."""
        text = self.joined(ids)
        return text.removeprefix(" ") if ids and self.pieces[ids[0]].startswith(MARK) else text

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of lists of ids that lie one after the other, list k from ends[k] to ends[k + 1]: the bytes of all tokens are gathered at once."""
        first = ids[ends[:-1][np.diff(ends) > 0]]
        wide = self.width[ids]
        at = np.concatenate(([0], np.cumsum(wide)))
        data = self.blob[np.repeat(self.place[ids] - at[:-1], wide) + np.arange(at[-1])]
        cuts = at[ends]
        begin = cuts[:-1].copy()
        begin[np.diff(ends) > 0] += self.marked[first]
        beyond = np.concatenate(([0], np.cumsum(self.high[ids])))[ends]
        plain, broken = data.tobytes(), np.flatnonzero(np.diff(beyond))
        if not len(broken) and (begin == cuts[:-1]).all():
            return pa.StringArray.from_buffers(len(begin), pa.py_buffer(cuts.astype("i4")), pa.py_buffer(plain))
        texts = [plain[a:b] for a, b in zip(begin.tolist(), cuts[1:].tolist())]
        for k in broken.tolist():  # bytes that may form no character
            texts[k] = self.decode(ids[ends[k] : ends[k + 1]].tolist()).encode()
        return pa.array(texts, pa.binary()).cast(pa.string())


def _characters(run: bytes) -> str:
    """Bytes as UTF-8; each byte that belongs to no character is one replacement sign."""
    out = []
    while True:
        try:
            return "".join(out) + run.decode()
        except UnicodeDecodeError as e:
            out += [run[: e.start].decode(), "\ufffd"]
            run = run[e.start + 1 :]


@loader
@lru_cache(maxsize=2)
def load(path: str) -> MergeEncoder:
    """One encoder for each model and Python worker."""
    return MergeEncoder(path)


TEXTS = 256  # of which ids and text are held at a time


def _lists(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(found), "i4"), np.cumsum([0, *map(len, found)]) // 4


def encode_tokens(docs: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (doc_id alone unless named) with ids, the tokens of each text, and decoded, the text that these ids give.

    A column of keep with the name of a result is called <name>_in.
    """
    row, out = carried(keep, "ids", "decoded")
    rows = docs.select(row, text_or_empty().alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(load)
        encoder = load(model)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                some = batch.slice(i, TEXTS)
                with uncollected():
                    ids, ends = _lists(encoder.encode_all(some.column("_text").to_pylist()))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([some.column("_row"), lists, encoder.decode_all(ids, ends)], names=["_row", "ids", "decoded"])

    found = rows.mapInArrow(encode, f"_row {rows.schema['_row'].dataType.simpleString()}, ids array<int>, decoded string")
    return found.select(*out, "ids", "decoded")


def token_ids(text: Column, model: str) -> Column:
    """The ids of each text as an array; null for a null text."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = load(model)
        for batch in batches:
            texts = batch.to_pylist()
            ids, ends = _lists(encoder.encode_all([x or "" for x in texts]))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), mask=pa.array([x is None for x in texts], pa.bool_()))

    return encode(text)


def decoded(ids: Column, model: str) -> Column:
    """The text of each array of ids; null for a null array. Null elements are not allowed."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = load(model)
        for batch in batches:
            yield pa.array([None if x is None else encoder.decode(x) for i in range(len(batch)) for x in batch.slice(i, 1).to_pylist()], pa.string())

    return decode(ids)


def digests() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 from the columns of encode_tokens."""
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def encode_documents(docs: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (doc_id alone unless named) with n_tokens, ids_sha256 and decoded_sha256, from the tokens and the text decoded from them."""
    row, out = carried(keep, "n_tokens", "ids_sha256", "decoded_sha256")
    return encode_tokens(docs.select(row, "text"), model, ["_row"]).select(*out, *digests())
