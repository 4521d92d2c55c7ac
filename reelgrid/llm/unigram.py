"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a public ``.model`` file. No piece holds the white-space
marker after another character, so the best path of a text is that of its
chunks, each a run of markers with what follows up to the next marker. Chunks
are looked up in a bounded cache; those of a batch that are new are solved
together, one array step for each (start, length) of all chunks.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import in_pieces, text_or_empty

MARK = "▁"
#: Piece kinds of the file format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Fixed value: how far a character without a piece lies below the least score.
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 300_000
#: Bytes of the chunks that are solved together; longer ones are solved alone.
TOGETHER = 64

_chunks = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+").findall


def default_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(raw: bytes):
    """(field, value) of a protocol-buffer message."""

    def varint(at):
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id, from a file with the identity normaliser and a dummy prefix."""
    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for field, value in _fields(raw):
        if field == 1:
            own = dict(_fields(value))
            out.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
        elif field == 3:
            own = dict(_fields(value))
            if own.get(2) or not own.get(3, 1) or own.get(4, 1):
                raise ValueError(f"{path}: its normaliser isn't the identity with a dummy prefix")
    return out


def log_scores(pieces: list[tuple[str, float, int]]) -> list[float]:
    """Log scores of the normal pieces.

    A file of merges ranks its pieces by negative whole numbers. Such ranks
    become log probabilities by Zipf's rule, minus log of rank less log of the
    harmonic sum; scores of any other file are taken as they are.
    """
    normal = [i for i, p in enumerate(pieces) if p[2] == NORMAL]
    if any(pieces[i][1] != int(pieces[i][1]) for i in normal):
        return [p[1] for p in pieces]
    order = sorted(normal, key=lambda i: (-pieces[i][1], i))
    total = np.log(np.sum(1.0 / np.arange(1, len(order) + 1)))
    out = [0.0] * len(pieces)
    for rank, i in enumerate(order, 1):
        out[i] = float(-np.log(rank) - total)
    return out


class DoubleArray:
    """A trie over bytes in two arrays: from node n, byte b leads to m = base[n] + b + 1 if check[m] == n."""

    def __init__(self, keys: dict[bytes, int]):
        cells = 2 * sum(map(len, keys)) + 1024
        base, check, value = np.zeros(cells, np.int32), np.full(cells, -1, np.int32), np.full(cells, -1, np.int32)
        check[0], first_free = 0, 1
        names = sorted(keys)
        todo = [(0, 0, len(names), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(names[lo]) == depth:
                value[node] = keys[names[lo]]
                lo += 1
            if lo == hi:
                continue
            heads, at = [], lo
            while at < hi:
                b, start = names[at][depth], at
                while at < hi and names[at][depth] == b:
                    at += 1
                heads.append((b, start, at))
            offsets = np.array([b + 1 for b, _, _ in heads])
            while check[first_free] >= 0:
                first_free += 1
            spot = self._spot(check, offsets, first_free)
            base[node] = spot
            for b, start, stop in heads:
                check[spot + b + 1] = node
                todo.append((spot + b + 1, start, stop, depth + 1))
        used = int(np.flatnonzero(check >= 0)[-1]) + 258  # 257 free cells: no step leaves the arrays
        self.base, self.check, self.value = base[:used], check[:used], value[:used]

    @staticmethod
    def _spot(check: np.ndarray, offsets: np.ndarray, first_free: int) -> int:
        """The first place where all children fit, tried a window of free cells at a time."""
        at = max(first_free, int(offsets[0]) + 1)
        if len(offsets) == 1 and check[at] < 0:
            return at - int(offsets[0])
        while True:
            free = at + np.flatnonzero(check[at : at + 2048] < 0)
            fits = (check[free[:, None] + (offsets - offsets[0])] < 0).all(axis=1)
            if fits.any():
                return int(free[fits.argmax()] - offsets[0])
            at += 2048


@dataclass
class Unigram:
    trie: DoubleArray
    score: np.ndarray
    unknown: float
    byte_ids: list[int]
    surface: list[bytes]
    is_byte: np.ndarray
    longest: int

    @classmethod
    def load(cls, path: str) -> Unigram:
        pieces = read_model(path)
        score = np.array(log_scores(pieces))
        keys = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        if any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind == NORMAL):
            raise ValueError(f"{path}: a piece has the white-space marker inside")
        byte_ids = [i for i, (_, _, kind) in enumerate(pieces) if kind == BYTE]
        if [pieces[i][0] for i in byte_ids] != [f"<0x{b:02X}>" for b in range(256)]:
            raise ValueError(f"{path}: it lacks byte pieces")
        surface = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind == NORMAL else b"" for p, _, kind in pieces]
        is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        return cls(DoubleArray(keys), score, float(min(score[list(keys.values())])) - UNKNOWN_PENALTY, byte_ids, surface, is_byte, max(map(len, keys)))

    def solve(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian unsigned 32-bit bytes."""
        raws = [c.encode() for c in chunks]
        out: list[bytes] = [b""] * len(raws)
        order = sorted((i for i, r in enumerate(raws) if len(r) <= TOGETHER), key=lambda i: len(raws[i]))
        for at in range(0, len(order), 8192):
            part = order[at : at + 8192]
            width = len(raws[part[-1]])
            grid = np.frombuffer(b"".join([raws[i].ljust(width, b"\0") for i in part]), np.uint8).reshape(len(part), width)
            back, piece = self._paths(grid, np.array([len(raws[i]) for i in part]))
            for row, i in enumerate(part):
                out[i] = self._trace(raws[i], back[row], piece[row])
        for i, r in enumerate(raws):
            if len(r) > TOGETHER:
                out[i] = self._trace(r, *self._path(r))
        return out

    def _paths(self, grid: np.ndarray, sizes: np.ndarray) -> tuple[list, list]:
        """Best start and piece for each end, of all rows of ``grid`` at once."""
        n, width = grid.shape
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        char_bytes = np.ones((n, width), np.int64)
        for low, more in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            char_bytes[grid >= low] = more
        opens = (grid & 0xC0) != 0x80
        for s in range(width):
            rows = np.flatnonzero(opens[:, s] & (sizes > s))
            if not len(rows):
                continue
            one, single = s + char_bytes[rows, s], np.zeros(len(rows), bool)
            live, node, alive = rows, np.zeros(len(rows), np.int64), np.arange(len(rows))
            for e in range(s, min(width, s + self.longest)):
                inside = sizes[live] > e
                live, node, alive = live[inside], node[inside], alive[inside]
                step = base[node] + grid[live, e].astype(np.int64) + 1
                ok = check[step] == node
                live, node, alive = live[ok], step[ok], alive[ok]
                if not len(live):
                    break
                ids = value[node]
                has = ids >= 0
                if has.any():
                    r, p = live[has], ids[has]
                    single[alive[has]] |= one[alive[has]] == e + 1
                    total = best[r, s] + self.score[p]
                    better = total > best[r, e + 1]
                    r, p = r[better], p[better]
                    best[r, e + 1], back[r, e + 1], piece[r, e + 1] = total[better], s, p
            r, e = rows[~single], one[~single]
            total = best[r, s] + self.unknown
            better = total > best[r, e]
            r, e = r[better], e[better]
            best[r, e], back[r, e], piece[r, e] = total[better], s, -1
        return back.tolist(), piece.tolist()

    def _path(self, raw: bytes) -> tuple[list, list]:
        """The same for one chunk of any length."""
        n = len(raw)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, score = self._lists()
        s = 0
        while s < n:
            b = raw[s]
            one = s + (1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
            node, single, here = 0, False, best[s]
            for e in range(s, min(n, s + self.longest)):
                step = base[node] + raw[e] + 1
                if check[step] != node:
                    break
                node = step
                if (p := value[node]) >= 0:
                    single |= e + 1 == one
                    if here + score[p] > best[e + 1]:
                        best[e + 1], back[e + 1], piece[e + 1] = here + score[p], s, p
            if not single and here + self.unknown > best[one]:
                best[one], back[one], piece[one] = here + self.unknown, s, -1
            s = one
        return back, piece

    def _lists(self):
        if not hasattr(self, "_as_lists"):
            self._as_lists = (self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.score.tolist())
        return self._as_lists

    def _trace(self, raw: bytes, back, piece) -> bytes:
        ids, end = [], len(raw)
        while end:
            start = back[end]
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                ids += [self.byte_ids[b] for b in reversed(raw[start:end])]
            end = start
        return struct.pack(f"<{len(ids)}I", *reversed(ids))


class Codec:
    """Encoding and decoding of whole texts with a bounded cache of chunks."""

    def __init__(self, model: Unigram):
        self.model = model
        self.cache: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text; an empty text has none."""
        cut = [_chunks(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.cache
        new = list({c: 0 for chunks in cut for c in chunks if c not in known})
        solved = dict(zip(new, self.model.solve(new), strict=True))
        for c, ids in solved.items():
            if len(known) >= CACHE_ENTRIES:
                break
            if len(c) <= TOGETHER:
                known[c] = ids
        get = lambda c: known[c] if c in known else solved[c]
        return [np.frombuffer(b"".join(map(get, chunks)), "<u4") for chunks in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids: bytes joined, markers as spaces, the dummy prefix off; broken UTF-8 is replaced."""
        raw = b"".join(map(self.model.surface.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode(errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(Unigram.load(path))


#: The codec of this worker for each model that was sent to it.
_sent: dict[str, Codec] = {}


def _sender(spark, path: str):
    """A function for workers that gives the codec of ``path``; the trie is built once, on the driver, and is as large as the vocabulary."""
    held = spark.sparkContext.broadcast(codec(path).model)

    def own() -> Codec:
        if path not in _sent:
            _sent[path] = Codec(held.value)
        return _sent[path]

    return own


def encode(docs: DataFrame, id_col="doc_id", text_col="text", model: str | None = None) -> DataFrame:
    """id_col, piece_ids array<int>, each row by itself.

    Null text counts as empty and has no pieces; a text of any length is
    encoded whole; null and repeated ids and repeated rows pass through; an
    empty table gives an empty result; other columns are not read.
    """
    sent = _sender(docs.sparkSession, model or default_model())

    def run(batches):
        own = sent()
        for b in in_pieces(batches):
            ids = own.encode_batch(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["id", "piece_ids"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece_ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col="doc_id", ids_col="piece_ids", model: str | None = None) -> DataFrame:
    """id_col, text, each row by itself.

    A null or empty list of pieces decodes to the empty text; null and repeated
    ids and repeated rows pass through; an empty table gives an empty result;
    other columns are not read.
    """
    sent = _sender(encoded.sparkSession, model or default_model())

    def run(batches):
        own = sent()
        for b in in_pieces(batches):
            texts = [own.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trips(docs: DataFrame, id_col="doc_id", text_col="text", model: str | None = None) -> DataFrame:
    """id_col, n_pieces, n_byte_pieces, ids_crc32, text (decoded), round_trip.

    ``ids_crc32`` is of little-endian unsigned 32-bit ids. A text with the
    marker character itself decodes it to a space: its round_trip is false.
    Null text counts as empty; null and repeated ids pass through; an empty
    table gives an empty result; other columns are not read.
    """
    sent = _sender(docs.sparkSession, model or default_model())

    def run(batches):
        own = sent()
        for b in in_pieces(batches):
            texts = b.column("text").to_pylist()
            ids = own.encode_batch(texts)
            back = [own.decode(x) for x in ids]
            cols = [
                b.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(own.model.is_byte[x].sum()) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(back, pa.string()), pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_pieces", "n_byte_pieces", "ids_crc32", "text", "round_trip"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_pieces long, n_byte_pieces long, ids_crc32 long, text string, round_trip boolean").withColumnRenamed("id", id_col)


def op2_sentencepiece(spark, sf_dir):
    out = round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"), "round_trip")


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
