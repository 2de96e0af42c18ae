"""Byte-level BPE with given ranks: splitting texts into pre-tokens, and encoding pre-tokens.

The pieces are the matches of the public pattern. Three splitters give the same pieces: Python's `re` with
explicit classes where all characters lie below U+0250, the `regex` library elsewhere, and, where that library
knows letters or numbers that the BPE library does not know yet, the same after such characters are replaced by
a private one for the split.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Below U+0250: white space, letters and numbers, as Unicode has them.
_S, _L, _N = r"\t-\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
_OTHER = ""
#: Pre-tokens over so many bytes are merged with a heap, in time near-linear in their length.
_LONG = 1024
#: Entries of a worker's cache of pre-tokens; a full cache is emptied.
CACHE = 1_000_000


@lru_cache
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@lru_cache
def _unknown() -> dict[int, str]:
    """Characters that `regex` takes for letters or numbers and the BPE library does not."""
    import regex
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    newer = regex.compile(r"[\p{L}\p{N}]")
    known = tiktoken.Encoding("classes", pat_str=r"\p{L}|\p{N}", mergeable_ranks=ranks, special_tokens={})
    out = {}
    for c in (*range(0x250, 0xD800), *range(0xE000, 0x110000)):
        ch = chr(c)
        if unicodedata.category(ch) == "Cn" and newer.match(ch) and not known.encode_ordinary(ch):
            out[c] = _OTHER
    return out


def pieces(text: str) -> list[str]:
    """The pre-tokens of a text; joined they are the text."""
    if not _BEYOND_LATIN.search(text):
        return _LATIN.findall(text)
    plain = text.translate(_unknown())
    found = _pattern().findall(plain)
    if plain == text:
        return found
    out, at = [], 0
    for p in found:
        out.append(text[at : at + len(p)])
        at += len(p)
    return out


class Encoder(dict):
    """Maps a pre-token to its ids as little-endian unsigned 32-bit integers; a dict that fills itself."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        super().__init__()
        self.ranks = ranks
        self.whole = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        if len(raw) > _LONG:
            return np.array(self.merge(raw), "<u4").tobytes()
        ids = np.array(self.whole._encode_single_piece(raw), "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """The least rank is merged first, the leftmost of equals; by a heap of pairs and linked parts."""
        n, ranks = len(raw), self.ranks
        end = list(range(1, n + 1))  # of the part that starts here; 0 where none does
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := ranks.get(raw[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two parts has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, pieces(text)))


@lru_cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache
def encoder(path: str) -> Encoder:
    """The encoder of a rank file, one for each worker process."""
    return Encoder(read_ranks(path))


@lru_cache
def id_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        out[i] = raw
    return out


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
