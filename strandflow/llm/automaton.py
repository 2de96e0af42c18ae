"""BPE encoding by a tokenization automaton, and decoding by the labels of its arcs.

The automaton is deterministic, reads tokens, and accepts a sequence of tokens only if it is what the merges make of
the bytes it stands for. It starts as one state with an arc for each byte, and each merge u v -> w in turn applies a gadget:

* wherever u leads to a state q with an arc for v, u is led to a copy of q without that arc, so that u v is no longer read;
* each state with an arc for u gets one for w, which leads where the arc for v led.

All arcs of one token lead to the same state, since each merge sees only the last token read, so `target` has one state for
each token, and a gadget makes one state at most. Arcs are not stored while gadgets are applied, as there would be billions: a
state has its parent and the token it lost, and a token its two halves. The arcs of a state follow from these, as one row of
bits for all tokens, which is written out when the state is first met (`row`).

A pre-split word is encoded by transitions: where a token ends, the row of its state and a table of tokens' prefixes, read from byte
to byte, tell which arcs can be read on. The longest is taken first, and the next one where that leads nowhere. A word has exactly one
path to its end, and each of its places at most one path that leads there, so no place is read from twice and the time is linear in
the word's length.

Strings of special tokens in a text become these tokens (`specials`), as the file states them. Rows are encoded on their own, by words;
each word is encoded once in a task. Decoding joins the arcs' labels and reads them as UTF-8; what is no UTF-8 becomes U+FFFD.

Defined cases: a null text counts as empty and has no ids; repeated rows are each a row; long texts are whole, and so are long words;
columns besides doc_id and text are ignored. Ids that no token has are left out in decoding, null ids have the empty text.
A file whose merges join tokens that no earlier merge made, or make one token in two ways, is refused (ValueError).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandflow.llm import bpe
from strandflow.llm.common import batch_of, id_text, map_batches

#: Rows of arcs that a worker keeps, each of as many bits as there are tokens; words of a worker are bounded as in `bpe`.
ROWS = 8192
_NEVER = np.iinfo(np.int32).max


class Automaton:
    """States and tokens of a BPE file. Pickled, it holds these tables alone; rows and prefixes are made where it is used."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], specials: dict[str, int] | None = None):
        """labels: the bytes of each id; merges: (u, v, w) in the order of their ranks."""
        n = len(labels)
        self.labels, self.specials = labels, dict(specials or {})
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.time = np.full(n, -1, np.int32)  # of the merge that makes a token; -1: a byte or no token of the automaton
        self.target = [0] * n
        self.parent, self.lost, self.since = [-1], [-1], [-1]
        made = [len(b) == 1 for b in labels]
        read = list(made)  # tokens that some state has an arc for
        gone: dict[tuple[int, int], int] = {}  # token, next token: the gadget that parted them
        for time, (u, v, w) in enumerate(merges):
            if not (made[u] and made[v]) or made[w]:
                raise ValueError(f"merge {time} joins tokens that are not made yet, or makes a token again")
            made[w] = True
            if not (read[u] and read[v] and self._arc(u, v, gone)):
                continue  # u v is read nowhere: earlier merges took one of them apart from the other
            read[w], self.left[w], self.right[w], self.time[w] = True, u, v, time
            self.target[w] = self.target[v]
            gone[u, v] = time
            self.parent.append(self.target[u])
            self.lost.append(v)
            self.since.append(time)
            self.target[u] = len(self.parent) - 1
        self.tokens = np.flatnonzero(np.array(read, bool)).astype(np.int32)
        self.longest = max((len(labels[t]) for t in self.tokens.tolist()), default=0)
        self._reset()

    def _arc(self, u: int, v: int, gone: dict) -> bool:
        """Whether the state after u has an arc for v, all gadgets so far considered.

        The state after u is that of its right half when u was made, less what was lost since; an arc for v came from that for its
        left half. So the arc is missing if a gadget parted two halves of them, before either grew on.
        """
        a, until_a = u, _NEVER
        while a >= 0:
            b, until_b = v, _NEVER
            while b >= 0:
                parted = gone.get((a, b))
                # A token made by a gadget leads to where its right half led before that gadget; only what reads its left half after it reads it.
                if parted is not None and parted < until_a and parted <= until_b:
                    return False
                until_b = self.time[b]
                b = self.left[b]
            until_a = self.time[a]
            a = self.right[a]
        return True

    def _reset(self) -> None:
        self._rows: dict[int, bytes] = {}
        self._next: dict[int, int] | None = None
        self._by_left: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def row(self, state: int) -> bytes:
        """One bit for each token: whether the state has an arc for it."""
        found = self._rows.get(state)
        if found is None:
            if len(self._rows) >= ROWS:
                self._rows.clear()
            found = self._rows[state] = self._written(state)
        return found

    def _written(self, state: int) -> bytes:
        here = np.zeros(len(self.labels), bool)
        here[self.tokens] = True
        without, since = [], []
        while state > 0:
            without.append(self.lost[state])
            since.append(self.since[state])
            state = self.parent[state]
        without, since = np.array(without, np.int64), np.array(since, np.int64)
        begin, grown = self._grown()
        while len(without):
            here[without] = False
            # What was made of a token when it was lost, or after, has no arc, nor has what was made of that.
            n = begin[without + 1] - begin[without]
            of = np.repeat(begin[without] - np.cumsum(n) + n, n) + np.arange(n.sum())
            made = grown[of]
            without = made[self.time[made] >= np.repeat(since, n)]
            since = np.full(len(without), -1, np.int64)
        return np.packbits(here, bitorder="little").tobytes()

    def _grown(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens by their left halves, and where those of each left half begin."""
        if self._by_left is None:
            made = self.tokens[self.left[self.tokens] >= 0]
            grown = made[np.argsort(self.left[made], kind="stable")].astype(np.int64)
            begin = np.searchsorted(self.left[grown], np.arange(len(self.labels) + 1)).astype(np.int64)
            self._by_left = begin, grown
        return self._by_left

    def prefixes(self) -> tuple[dict[int, int], list[int]]:
        """The tree of the labels: (node << 8 | byte) to node, and the token that a node is, or -1."""
        if self._next is None:
            step, token = {}, [-1]
            for t in self.tokens.tolist():
                node = 0
                for byte in self.labels[t]:
                    key = node << 8 | byte
                    node = step.get(key, 0)
                    if not node:
                        node = step[key] = len(token)
                        token.append(-1)
                token[node] = t
            self._next, self._token = step, token
        return self._next, self._token

    def encode_word(self, raw: bytes) -> list[int]:
        """The one path of arcs that spells the word, looked for by the longest arcs first."""
        if not raw:
            return []
        n, target, labels = len(raw), self.target, self.labels
        path, starts, open_arcs = [], [0], [self._readable(raw, 0, 0)]
        while starts:
            if not open_arcs[-1]:
                open_arcs.pop()
                starts.pop()
                if path:
                    path.pop()
                continue
            t = open_arcs[-1].pop()
            stop = starts[-1] + len(labels[t])
            path.append(t)
            if stop == n:
                return path
            starts.append(stop)
            open_arcs.append(self._readable(raw, stop, target[t]))
        raise ValueError("the word has a byte without a token")

    def _readable(self, raw: bytes, start: int, state: int) -> list[int]:
        """The tokens that stand in the word from `start` on and that the state has arcs for, the longest last."""
        step, token = self._next or self.prefixes()[0], self._token
        row = self._rows.get(state) or self.row(state)
        out, node = [], 0
        for byte in raw[start : start + self.longest]:
            node = step.get(node << 8 | byte)
            if node is None:
                break
            t = token[node]
            if t >= 0 and row[t >> 3] >> (t & 7) & 1:
                out.append(t)
        return out

    def accepts(self, tokens: list[int]) -> bool:
        """Whether the tokens are the encoding of the one word that they spell."""
        state = 0
        for t in tokens:
            row = self.row(state)
            if not 0 <= t < len(self.labels) or not row[t >> 3] >> (t & 7) & 1:
                return False
            state = self.target[t]
        return True

    def arcs(self, state: int) -> list[tuple[int, int]]:
        """Token and next state of all arcs of a state."""
        bits = np.unpackbits(np.frombuffer(self.row(state), np.uint8), bitorder="little")
        return [(t, self.target[t]) for t in np.flatnonzero(bits).tolist()]

    def decode(self, ids: list[int]) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in ids if i < len(labels)]).decode("utf-8", "replace")


class Words(dict):
    """Maps a pre-token to its ids as little-endian unsigned 32-bit integers; fills itself."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton
        found = sorted(automaton.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.automaton.encode_word(word.encode()), "<u4").tobytes()
        if len(self) >= bpe.CACHE:
            self.clear()
        if len(word) <= 1024:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return b"".join(map(self.__getitem__, bpe.pieces(text)))
        out = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(np.array([self.automaton.specials[part]], "<u4").tobytes())
            else:
                out += map(self.__getitem__, bpe.pieces(part))
        return b"".join(out)


def _characters() -> dict[str, int]:
    """The character that stands for each byte in files of byte-level BPE: itself if it is printable Latin-1, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache
def compiled(path: str) -> Automaton:
    """The automaton of a byte-level BPE file of the `tokenizers` format, made once in the driver."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added, byte = file["model"], file["added_tokens"], _characters()
    ids = model["vocab"]
    labels = [b""] * (max([*ids.values(), *(t["id"] for t in added)]) + 1)
    for token, i in ids.items():
        labels[i] = bytes(byte[c] for c in token)
    for t in added:
        labels[t["id"]] = t["content"].encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Automaton(labels, [(ids[u], ids[v], ids[u + v]) for u, v in pairs], {t["content"]: t["id"] for t in added})


_words: dict[int, Words] = {}


def _local(shared) -> Words:
    """This worker's words of a broadcast automaton; those of another are dropped."""
    if shared.id not in _words:
        _words.clear()
        _words[shared.id] = Words(shared.automaton)
    return _words[shared.id]


class Shared:
    """An automaton broadcast to workers: its size is that of the vocabulary (about 3 MB for 50,000 tokens)."""

    def __init__(self, spark, automaton: Automaton):
        self._sent = spark.sparkContext.broadcast(automaton)
        self.id = self._sent._jbroadcast.id()

    @property
    def automaton(self) -> Automaton:
        return self._sent.value

    def __getstate__(self) -> tuple:
        return self._sent, self.id

    def __setstate__(self, state: tuple) -> None:
        self._sent, self.id = state


def encode_documents(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every row of docs."""
    shared = Shared(docs.sparkSession, automaton)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = _local(shared).encode
        return batch_of(doc_id=batch.column("doc_id"), ids=pa.array([encode(t) for t in batch.column("text").to_pylist()], pa.binary()))

    return map_batches(id_text(docs), run, "doc_id long, ids binary", lambda: _local(shared).clear())


def decode_documents(encoded: DataFrame, automaton: Automaton) -> DataFrame:
    """doc_id, ids and text of rows of doc_id and ids."""
    shared = Shared(encoded.sparkSession, automaton)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = _local(shared).automaton.decode
        texts = [decode(np.frombuffer(ids or b"", "<u4").tolist()) for ids in batch.column("ids").to_pylist()]
        return batch_of(doc_id=batch.column("doc_id"), ids=batch.column("ids"), text=pa.array(texts, pa.string()))

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, text string")
