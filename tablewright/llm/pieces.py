"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

A text is marked ("▁" before it and for each space) and cut into marked words, which no piece spans. The distinct words of
a chunk are sorted, so that they lie in the order of a depth-first walk of their trie: a word takes over the forward
scores of the prefix that it shares with the word before it, and only the rest is scored. Pieces are kept in a trie of their
own, spelt backwards: from each end it is walked towards the word's start, as far as any piece goes. The best way to a position is the
largest sum of piece scores; of equal ones the one with the longest last piece. A file of merged pieces scores them by merge
rank, which says nothing of probability: -log(100 + rank) stands for it there. Characters outside the vocabulary become their byte pieces.

The model file is only read, never trained. Decoding gives back the text, where it holds no "▁" of its own. Null text: empty, no pieces.
Null ids, ties and repeated rows are encoded like others; an empty table gives an empty result. Texts of any length are read whole, other
columns play no part, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHE = 100_000  # words that a worker keeps, twice: those of late, and those before them


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _by_rank(rank: float) -> float:
    """Log probability of a piece by its merge rank, up to a constant: Zipf and Mandelbrot's law."""
    return -math.log(100 + rank) if rank < 1e8 else -30.0


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        raw = {i: sp.get_score(i) for i in plain}
        ranked = all(v == int(v) for v in raw.values())  # merge ranks, not log probabilities
        self.score = {self.pieces[i]: (_by_rank(-v) if ranked else v, i) for i, v in raw.items()}
        self.ends: dict = {}  # character: [score or None, piece, what comes before]
        for piece, (v, i) in self.score.items():
            level = self.ends
            for c in reversed(piece):
                node = level.setdefault(c, [None, -1, {}])
                level = node[2]
            node[0], node[1] = v, i
        self.raw = {i: p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.raw |= {i: bytes([b]) for i, b in self.of_byte.items()} | {i: b"" for i in range(len(self.pieces)) if sp.is_control(i) or sp.is_unknown(i)}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece spans words")
        self.unknown = min(s for s, _ in self.score.values()) - 10.0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, as little-endian bytes."""
        out: dict[str, bytes] = {}
        ends, unknown = self.ends, self.unknown
        best: list[float] = [0.0]  # forward score at each position of the current word
        back: list[tuple[int, int]] = [(0, -1)]  # where its last piece begins, and the piece
        last = ""
        for w in sorted(words):
            same = 0
            for a, b in zip(w, last, strict=False):
                if a != b:
                    break
                same += 1
            del best[same + 1 :], back[same + 1 :]
            for end in range(same + 1, len(w) + 1):
                top, how = best[end - 1] + unknown, (end - 1, -1)
                level, start = ends, end
                while start and (node := level.get(w[start - 1])) is not None:
                    start -= 1
                    v, piece, level = node
                    if v is not None and best[start] + v >= top:  # of equal ones the longest
                        top, how = best[start] + v, (start, piece)
                best.append(top)
                back.append(how)
            ids, at = [], len(w)
            while at:
                start, piece = back[at]
                ids += [piece] if piece >= 0 else [self.byte[x] for x in reversed(w[start:at].encode())]
                at = start
            out[w] = np.array(ids[::-1], "<u4").tobytes()
            last = w
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. Words of a batch are searched together; those seen before are taken over."""
        cut = [_WORDS.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        known, older = self.known, self.older
        here = {w: known.get(w) or older.get(w) for w in set().union(*cut)}
        here.update(self.words([w for w, v in here.items() if v is None]))
        known.update((w, v) for w, v in here.items() if len(w) < 64)
        if len(known) > CACHE:
            self.older, self.known = known, {}
        return [b"".join(map(here.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes | list[int]) -> str:
        ids = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.decode("utf-8", "replace")[1:]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", per_batch: int = 1 << 20) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    return _each(docs, path, id_col, text_col, per_batch, "ids array<int>", lambda c, texts, raw: [pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in raw], pa.list_(pa.int32()))])


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", per_batch: int = 1 << 20) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip: whether decoding the ids gives the text back."""

    def columns(c: Codec, texts: list[str], raw: list[bytes]):
        return [pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array([c.decode(r) == t for r, t in zip(raw, texts, strict=True)])]

    return _each(docs, path, id_col, text_col, per_batch, "n_pieces long, ids_crc32 long, round_trip boolean", columns)


def _each(docs: DataFrame, path: str, id_col: str, text_col: str, per_batch: int, schema: str, columns) -> DataFrame:
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches):
        c = codec(path)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns(c, texts, c.encode(texts))], names=names)
            ids.clear(), texts.clear()
            return out

        ids, texts, size, kind = [], [], 0, None
        for b in batches:
            kind = b.schema.field(0).type
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids.append(doc.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > per_batch:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {schema}")
