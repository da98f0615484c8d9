"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the model's pieces reads a text once. At each position the output links list the pieces
that end there, longest first, and each relaxes the best score of that position (Viterbi over piece scores); a
character that no piece of its own covers costs the model's unknown penalty and becomes its UTF-8 bytes. No piece has a
space after another character, so a text falls into independent chunks, each a run of spaces and what follows; chunks
are remembered, some hundred thousand. Spaces are matched as spaces, so a literal U+2581 is encoded by its bytes and comes back.

The model is a file on the driver; its pieces (bounded by the vocabulary) are broadcast.

Defined results: a null or empty text has no pieces and decodes to ''; any other text decodes to itself, exactly; of
equal scores the longest last piece wins; ids of control pieces decode to nothing; null ids decode to null; repeated rows
are encoded as often as they stand; an empty table gives an empty result; other columns pass through unread, under their
own names unless they are called like the results.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, map_texts, quoted, to_python

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHED_CHARS = 64
UNKNOWN_PENALTY = 10.0
NORMAL, BYTE, CONTROL, OTHER = "normal", "byte", "control", "unknown"
_CHUNKS = re.compile(r" +[^ ]*")


class _Chunks(Remembered):
    LIMIT, OPERATOR = 1 << 17, "pieces"

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def release(self) -> None:
        super().release()
        _BUILT.clear()

    def made(self, rest: str) -> bytes:
        return np.array(self.codec.best_path(" " + rest), np.int32).tobytes()


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[str, ...]


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: BYTE if p.is_byte(i) else CONTROL if p.is_control(i) else OTHER if p.is_unknown(i) or p.is_unused(i) else NORMAL
    n = range(p.get_piece_size())
    return Vocabulary(tuple(p.id_to_piece(i) for i in n), tuple(p.get_score(i) for i in n), tuple(kind(i) for i in n))


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        normal = [(p.replace("▁", " "), v.scores[i], i) for i, p in enumerate(v.pieces) if v.kinds[i] == NORMAL]
        self.unknown = min((s for _, s, _ in normal), default=0.0) - UNKNOWN_PENALTY
        self.bytes_of = [b""] * len(v.pieces)
        self.byte_ids = [0] * 256
        for p, _, i in normal:
            self.bytes_of[i] = p.encode()
        for i, p in enumerate(v.pieces):
            if v.kinds[i] == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
        self.by_chunk = not any(" " in p.lstrip(" ") for p, _, _ in normal)
        self.cache = _Chunks(self)
        self._build(normal)

    def _build(self, normal: list[tuple[str, float, int]]) -> None:
        self.goto: list[dict[str, int]] = [{}]
        self.fail, self.output, self.piece, self.depth, self.score = [0], [0], [-1], [0], [0.0]
        for text, score, i in normal:
            state = 0
            for c in text:
                if c not in self.goto[state]:
                    self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    for column, value in ((self.fail, 0), (self.output, 0), (self.piece, -1), (self.depth, self.depth[state] + 1), (self.score, 0.0)):
                        column.append(value)
                state = self.goto[state][c]
            self.piece[state], self.score[state] = i, score
        nothing: dict[str, int] = {}
        self.goto = [g or nothing for g in self.goto]  # leaves share one
        queue = deque(self.goto[0].values())
        while queue:
            state = queue.popleft()
            for c, to in self.goto[state].items():
                at = self.fail[state]
                while at and c not in self.goto[at]:
                    at = self.fail[at]
                self.fail[to] = self.goto[at].get(c, 0) if state else 0
                queue.append(to)
            shorter = self.fail[state]
            self.output[state] = shorter if self.piece[shorter] >= 0 else self.output[shorter]

    def best_path(self, text: str) -> list[int]:
        """Ids of the path of the highest score over text, where spaces are as the pieces have them."""
        goto, fail, output, piece, depth, score = self.goto, self.fail, self.output, self.piece, self.depth, self.score
        best, back, chosen = [0.0], [0], [-1]
        state = 0
        for end, c in enumerate(text, 1):
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            at = state if piece[state] >= 0 else output[state]
            top, start, which, single = None, 0, -1, False
            while at:
                value = best[end - depth[at]] + score[at]
                if top is None or value > top:
                    top, start, which = value, end - depth[at], piece[at]
                single = depth[at] == 1
                at = output[at]
            if not single:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    top, start, which = value, end - 1, -1
            best.append(top)
            back.append(start)
            chosen.append(which)
        ids, at = [], len(text)
        while at:
            if chosen[at] >= 0:
                ids.append(chosen[at])
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[back[at] : at].encode("utf-8", "surrogatepass")))
            at = back[at]
        ids.reverse()
        return ids

    def _chunk(self, rest: str) -> bytes:
        """Packed ids of a space and rest."""
        return self.cache[rest] if len(rest) <= CACHED_CHARS else self.cache.made(rest)

    def encode(self, text: str | None) -> bytes:
        """Ids as packed 32-bit integers. One space is put before the text, as the model was made."""
        if not text:
            return b""
        if not self.by_chunk:
            return np.array(self.best_path(" " + text), np.int32).tobytes()
        if "  " in text or text[0] == " ":
            return b"".join(self._chunk(x[1:]) for x in _CHUNKS.findall(" " + text))
        return b"".join(map(self._chunk, text.split(" ")))

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_BUILT: list[tuple[Vocabulary, Codec]] = []


def codec_of(vocabulary: Vocabulary) -> Codec:
    """The last one built in this process, which tasks of a worker share, if it is of the same vocabulary."""
    if not _BUILT or _BUILT[0][0] is not vocabulary:
        _BUILT[:] = [(vocabulary, Codec(vocabulary))]
    return _BUILT[0][1]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns of all rows, n_pieces, ids, and round_trip: whether decoding the ids gives the text again."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make(texts: list[str | None]) -> list[pa.Array]:
        codec = codec_of(shipped.value)
        packed = [codec.encode(t) for t in texts]
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        flat = np.frombuffer(b"".join(packed), np.int32)
        same = [codec.decode(flat[a:b]) == (t or "") for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]
        return [pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)), pa.array(same)]

    made = [T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    return map_texts(docs, list(keep), text, made, make, "pieces")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns of all rows and text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    rows = to_python(encoded.select(*quoted(*keep), *quoted(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shipped.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int32)) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keep)], T.StructField("text", T.StringType())]))
