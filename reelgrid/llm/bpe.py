"""Byte-level BPE from a public vocabulary file: pre-tokens, merges, caches.

A text is cut at its special strings, then at single spaces: a space that
follows a visible character and precedes another always begins a pre-token, so
the chunks between such spaces can be looked up on their own. Texts in which
white space holds two spaces are cut by the full pattern instead.
"""

from __future__ import annotations

import heapq
import json
import sys
from array import array
from functools import lru_cache

import regex

#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same cuts for texts in which no two white-space characters touch; it needs no look-ahead, so one linear scan finds them.
SINGLE_BLANKS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"

#: Entries of a worker's cache; later chunks are encoded without being kept.
CACHE_ENTRIES = 300_000

#: Pre-tokens above so many bytes are merged with a heap, in n log n steps.
LONG_PIECE = 400


def default_vocab(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """The vocabulary of one ``tokenizers`` file, with the merge step for a single pre-token."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        as_bytes = lambda s: bytes(symbols[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [self.ids[as_bytes(a + b)] for a, b in pairs]
        if made != sorted(set(made)):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        self.core = tiktoken.Encoding("own", pat_str=SINGLE_BLANKS, mergeable_ranks=self.ids, special_tokens={})._core_bpe
        self.pieces = regex.compile(PATTERN).findall
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.two_spaces = regex.compile(r" [^\S ]* ").search
        self.two_blanks = regex.compile(r"\s\s").search

    def is_plain(self, text: str) -> bool:
        """True if no white space touches other white space and no run of 2 * LONG_PIECE characters lacks a blank."""
        steps = range(0, len(text) - LONG_PIECE + 1, LONG_PIECE)
        return not self.two_blanks(text) and not any(" " not in (x := text[i : i + LONG_PIECE]) and "\n" not in x for i in steps)

    def merge(self, piece: str) -> list[int]:
        """Token ids of one pre-token."""
        raw = piece.encode()
        if len(raw) <= LONG_PIECE:
            return self.core.encode_single_piece(raw)
        return self._merge_long(raw)

    def _merge_long(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost first, over a linked list of parts."""
        n, ids = len(raw), self.ids
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n))
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ids.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            if not live[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            live[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ids.get(raw[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (p := before[i]) >= 0 and (r := ids.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ids[raw[i : end[i]]] for i in range(n) if live[i]]

    def whole_tokens(self) -> dict[str, int]:
        """The vocabulary strings that encode alone as one token, each proved by cutting and merging it."""
        out = {}
        for raw, i in self.ids.items():
            try:
                s = raw.decode()
            except UnicodeDecodeError:
                continue
            if self.pieces(s) == [s] and self.merge(s) == [i]:
                out[s] = i
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    """One vocabulary a worker and file."""
    return ByteBpe(path)


class _Cache(dict):
    """chunk -> value; remembers the first ``CACHE_ENTRIES`` chunks."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk):
        value = self.make(chunk)
        if len(self) < CACHE_ENTRIES and len(chunk) <= 64:
            self[chunk] = value
        return value


class _Folded:
    """A value for each text, put together from those of its chunks."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.spaced = _Cache(lambda chunk: self.of_chunk(" " + chunk)).__getitem__
        self.piece = _Cache(self.of_piece).__getitem__

    def of_chunk(self, chunk: str):
        return self.fold(map(self.piece, self.bpe.pieces(chunk)))

    def of_part(self, part: str):
        if self.bpe.two_spaces(part):
            return self.of_chunk(part)
        first, *rest = part.split(" ")
        return self.fold([self.of_chunk(first), *map(self.spaced, rest)])

    def __call__(self, text: str):
        cut = self.bpe.special_cut
        if cut is None or not any(s in text for s in self.bpe.special):
            return self.of_part(text)
        return self.fold(self.of_special(x) if i % 2 else self.of_part(x) for i, x in enumerate(cut(text)))


assert array("I").itemsize == 4 and sys.byteorder == "little"


class TokenIds(_Folded):
    """A text's token ids as little-endian unsigned 32-bit bytes."""

    fold = staticmethod(b"".join)

    def of_piece(self, piece: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.bpe.merge(piece)])

    def of_special(self, s: str) -> bytes:
        return self.bpe.special[s].to_bytes(4, "little")

    def of_part(self, part: str) -> bytes:
        if self.bpe.is_plain(part):
            return array("I", self.bpe.core.encode_ordinary(part)).tobytes()
        return super().of_part(part)


class TokenCount(_Folded):
    """A text's number of tokens: proved whole tokens count one, only other pre-tokens are merged."""

    fold = staticmethod(sum)

    def __init__(self, bpe: ByteBpe):
        super().__init__(bpe)
        self.whole = bpe.whole_tokens()

    def of_piece(self, piece: str) -> int:
        return 1 if piece in self.whole else len(self.bpe.merge(piece))

    def of_special(self, s: str) -> int:
        return 1


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(vocabulary(path))


@lru_cache(maxsize=2)
def token_count(path: str) -> TokenCount:
    return TokenCount(vocabulary(path))
