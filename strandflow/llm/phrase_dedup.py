"""Removal of passages that recur, located by sharded Aho-Corasick automata of repeated phrases.

A window is `window` consecutive words of a document. Every word under a window whose word sequence also starts
elsewhere is removed. Of each window the phrase (of `phrase` words) with the least hash is its anchor: equal
windows have equal anchors at the same place, and neighbouring windows mostly share theirs.

1. count: anchors are counted over all documents; a window whose anchor occurs once cannot recur;
2. confirm: documents are dealt into shards of about `shard_bytes` of text by a hash. Neighbouring windows of one
   repeated anchor make a stretch of words; each shard sends its different stretches, dealt by their anchors. Where
   all stretches of an anchor meet, their windows are counted, and what recurs goes back to the shards it came
   from, as passages of words with the place of their anchor. Stretches around anchors that more than `hot_shards` shards have stay
   with their shard: their windows' digests are counted instead, each window by itself, and those that recur go back;
3. locate: each shard cuts passages out of the stretches that stayed, compiles an automaton of its passages' anchors over word numbers, and all its documents stream
   through it. Every occurrence is extended to both sides, word by word, along the passages with that anchor; where
   `window` words or more agree, they are removed. Nothing but the automaton says where passages stand.

Documents travel to their shards twice, compressed in packs; nothing else of their size does. A shard sends a stretch once, however often it occurs there. No task gets more of an anchor
than `hot_shards` shards have of it: where an anchor or a window has many rows, sums are made within tasks first, and are joined with the rows
by salted keys. Windows are counted by digests of 96 bits, and words compared by hashes of 64.

Defined cases: a null or empty text has no words; a text shorter than a window keeps all its words; repeated
rows are documents of their own, so their windows recur, and where they are so many that they would fill a shard they
are counted before they travel; columns besides doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandflow.llm.common import batch_of, discard, free_names, id_text, map_batches, release, releasing, releasing2, salted_join, settle
from strandflow.llm.words import Words, gather, mix, sliding_argmin, window_hashes

WINDOW, PHRASE, SHARD_BYTES = 35, 8, 4 << 20
#: Shards whose stretches around one anchor meet in one task at most.
HOT_SHARDS = 64
#: Bytes of text that a task deals out over shards at a time.
DEAL_BYTES = 8 << 20
#: Parts of the hash range in which text is added up to find rows that repeat very often.
CELLS = 4096
_KEY = np.dtype([("w", "<u8"), ("s", "<u4")])
#: Pairs of an occurrence and a passage that are extended at a time.
_AT_ONCE = 1 << 18


class Scan:
    """The words of a column with, unless anchors is False, for each place where a window starts in one row, its anchor's place."""

    def __init__(self, column: pa.Array, window: int, phrase: int, anchors: bool = True):
        self.words = Words(column)
        self.hash = self.words.hashes()
        self.row = np.repeat(np.arange(len(column)), self.words.counts)
        self.window = window
        if not anchors:
            return
        self.phrase = window_hashes(self.hash, phrase, 2).view(np.int64)
        n = max(len(self.hash) - window + 1, 0)
        self.starts = np.flatnonzero(self.row[:n] == self.row[window - 1 :][:n])
        self.anchor = sliding_argmin(self.phrase, window - phrase + 1)[self.starts] if n else self.starts

    def stretches(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last start and the anchor's place of each run of neighbouring windows with one anchor, of the windows in `use`."""
        start, anchor = self.starts[use], self.anchor[use]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(start)) - 1
        return start[first], start[last[: len(first)]], anchor[first]

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Digests of stretches; first and last window overlap, so that they are all of it."""
        parts = []
        for seed in (1, 3):
            w = window_hashes(self.hash, self.window, seed)
            parts.append(mix(mix(w[first]) + w[last] * np.uint64(0x9FB21C651E98DF25) + (last - first).astype(np.uint64)))
        return key_array(parts[0], parts[1] >> np.uint64(32))


def windows_of(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The digests of the windows that start at the words `at`."""
    return key_array(window_hashes(h, window, 1)[at], mix(window_hashes(h, window, 3)[at]) >> np.uint64(32))


def recurring(keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which digests have a weight above one, all of the same digest together."""
    order, fresh = ordered(keys)
    new = np.flatnonzero(fresh)
    out = np.zeros(len(keys), bool)
    if len(new):
        out[order] = np.repeat(np.add.reduceat(weight[order], new) > 1, np.diff(np.append(new, len(keys))))
    return out


class Stretches:
    """Packed stretches with their marks (words before the anchor, whether they occur twice), and all their windows."""

    def __init__(self, packs: list[bytes], marks: list[bytes], window: int):
        lines, self.counts = lines_of(packs)
        self.marks = np.concatenate([np.frombuffer(m, "<i4").reshape(-1, 2) for m in marks])
        self.words, self.window = Words(lines), window
        many = self.words.counts - window + 1  # windows of each stretch
        self.of = np.repeat(np.arange(len(many)), many)
        self.start = self.words.first[:-1][self.of] + np.arange(len(self.of)) - np.repeat(np.cumsum(many) - many, many)
        self.keys = windows_of(self.words.hashes(), self.start, window)
        self.times = 1 + self.marks[self.of, 1].astype(np.int64)

    def passages(self, again: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """For each pack the runs of windows that are `again`, packed as words, and how many words come before their anchors."""
        of, start, words = self.of, self.start, self.words
        edge = np.r_[True, of[1:] != of[:-1]]
        begin = np.flatnonzero(again & (edge | ~np.r_[False, again[:-1]]))
        end = np.flatnonzero(again & (np.r_[edge[1:], True] | ~np.r_[again[1:], False]))
        text, line = texts_of(words, start[begin], start[end] + self.window)
        place = (words.first[:-1][of[begin]] + self.marks[of[begin], 0] - start[begin]).astype("<i4")
        bounds = np.searchsorted(of[begin], np.concatenate([[0], np.cumsum(self.counts)]))
        return packed(text, line[bounds]), [place[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def texts_of(words: Words, first: np.ndarray, stop: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Runs of words as lines of words between single blanks: the bytes of all lines, and where each begins."""
    count = stop - first
    ends = np.cumsum(count)
    word = np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
    out, to = gather(words.data, words.starts[word], (words.ends - words.starts)[word])
    out[to[ends] - 1] = 0x0A
    return out.tobytes(), to[np.concatenate([[0], ends])]


def lines_of(packs: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The lines of packed texts as a column, and how many lines each pack has."""
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [unpack(p) for p in packs]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.flatnonzero(data == 0x0A) + 1
    offsets = np.concatenate([[0], ends]).astype("<i8")
    counts = np.array([r.count(b"\n") for r in raw], np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), counts


def packed(text: bytes, bounds: np.ndarray) -> list[bytes]:
    """Slices of text, compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return [pack(text[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def key_array(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = np.empty(len(w), _KEY)
    out["w"], out["s"] = w, s
    return out


def binary_keys(keys: np.ndarray) -> pa.Array:
    """Digests as binary values."""
    offsets = np.arange(len(keys) + 1, dtype="<i4") * _KEY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys).tobytes())])


def repeats_of(seen: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """seen (a key, shard and n, once for each key and shard) as a written table, and the keys whose n is above one in all, with the size: their shards."""
    seen = settle(seen)
    return seen, settle(seen.groupBy(on).agg(F.sum("n").alias("all"), F.count("*").alias("size")).where(F.col("all") > 1).select(on, "size"))


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal digests together, and where in it a new digest begins."""
    order = np.argsort(keys["w"], kind="stable")
    w, s = keys["w"][order], keys["s"][order]
    same = w[1:] == w[:-1]
    if np.any(same & (s[1:] != s[:-1])):
        order = np.lexsort((keys["s"], keys["w"]))
        w, s = keys["w"][order], keys["s"][order]
        same = w[1:] == w[:-1]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ~(same & (s[1:] == s[:-1]))
    return order, fresh


def column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES, hot_shards: int = HOT_SHARDS) -> DataFrame:
    """doc_id, n_words, n_removed, text (the words that stay, joined by one space) and removed (runs of word places)."""
    return _located(id_text(docs), window, phrase, shard_bytes, hot_shards).drop("row")


def clean(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES, hot_shards: int = HOT_SHARDS) -> DataFrame:
    """docs with all its columns, the text of documents with repeats replaced by the words that stay (n_chars follows)."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    null, own = free_names(docs, "null", "id")
    row = F.struct(F.col("text").isNull().alias(null), F.col("doc_id").alias(own), *(F.col(f"`{c}`") for c in others))
    out = _located(id_text(docs.withColumn("__row", row), "__row").withColumnRenamed("__row", "row"), window, phrase, shard_bytes, hot_shards, False)
    touched = F.col("n_removed") > 0
    new = {"doc_id": F.col(f"row.{own}"), "text": F.when(~F.col(f"row.{null}"), F.col("text")), **{c: F.col(f"row.`{c}`") for c in others}}
    if "n_chars" in others:
        new["n_chars"] = F.when(touched, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) for c in docs.columns))


def dealt(d: DataFrame) -> DataFrame:
    """shard and pack: the rows of d, which has the column shard, a compressed pack for each shard and DEAL_BYTES of text in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= DEAL_BYTES:
                yield packs(held)
                held, size = [], 0
        if held:
            yield packs(held)

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        shard = t.column("shard").to_numpy()
        order = np.argsort(shard, kind="stable")
        t, shard = t.take(pa.array(order)).drop_columns(["shard"]).combine_chunks(), shard[order]
        begin = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(shard)])
        pack, out = zstandard.ZstdCompressor(level=1).compress, []
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(shard)).tolist(), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as stream:
                stream.write_table(t.slice(a, b - a))
            out.append(pack(sink.getvalue()))
        return batch_of(shard=pa.array(shard[begin], pa.int32()), pack=pa.array(out, pa.binary()))

    return d.mapInArrow(run, "shard int, pack binary")


def rows_of(t: pa.Table) -> pa.Table:
    """The rows of packs of one shard."""
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.concat_tables([pa.ipc.open_stream(unpack(p)).read_all() for p in t.column("pack").to_pylist()])


def _located(d: DataFrame, window: int, phrase: int, shard_bytes: int, hot_shards: int, tidy: bool = True) -> DataFrame:
    """As remove_repeats, with the column row of d if it has one; unless tidy, a text without repeats stays as it is."""
    phrase = min(phrase, window)
    if "row" not in d.columns:
        d = d.withColumn("row", F.lit(0))
    kind = d.schema["row"].dataType
    cell = F.pmod(F.xxhash64("doc_id", "text"), F.lit(CELLS))
    cells = {r.c: r.b for r in d.groupBy(cell.alias("c")).agg(F.sum(F.octet_length("text").cast("long")).alias("b")).collect()}
    total = sum(cells.values())
    shards = max(1, math.ceil(total / shard_bytes))
    # Only one very long text, or a row that repeats very often, makes a cell stand out so far.
    full = [c for c, b in cells.items() if b > 8 * total / CELLS + 4 * shard_bytes]
    d, repeats = d.withColumn("times", F.lit(1).cast("long")), None
    if full and "map<" not in kind.simpleString():
        repeats = d.where(cell.isin(full)).groupBy("doc_id", "text", "row").agg(F.count("*").alias("times"))
        d = d.where(~cell.isin(full)).unionByName(repeats)
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))

    # As many bits of the anchors' hashes as tell apart 64 times as many as there may be; a chance repeat is a candidate in vain.
    drop = np.int64(max(0, 58 - max(1, total // 16).bit_length()))

    def anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
        scan = Scan(batch.column("text"), window, phrase)
        at = np.unique(scan.anchor)
        shard, times = (batch.column(c).to_numpy()[scan.row[at]] for c in ("shard", "times"))
        return batch_of(phrase=pa.array(scan.phrase[at] >> drop, pa.int64()), shard=pa.array(shard, pa.int32()), n=pa.array(times, pa.int64()))

    seen = map_batches(d.select("shard", "text", "times"), anchors, "phrase long, shard int, n long").groupBy("phrase", "shard").agg(F.sum("n").alias("n"))
    seen, twice = repeats_of(seen, "phrase")
    repeated = salted_join(seen, twice, "phrase", "size", ["shard"]).select("shard", "phrase", (F.col("size") > hot_shards).alias("hot"))
    ranges = max(1, shards // 2)

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return sent([], [], [], [])
        shard, left = left.column("shard")[0].as_py(), rows_of(left)
        scan = Scan(column(left, "text"), window, phrase)
        known = column(right, "phrase").to_numpy()
        by = np.argsort(known)
        known, hot = known[by], column(right, "hot").to_numpy(zero_copy_only=False)[by]
        value = scan.phrase[scan.anchor] >> drop
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        is_hot = np.zeros(len(scan.hash), bool)  # by the anchor's place
        is_hot[scan.anchor] = hot[at]
        first, last, anchor = scan.stretches(known[at] == value)
        times = column(left, "times").to_numpy()[scan.row[first]]
        order, fresh = ordered(scan.digests(first, last))
        new = np.flatnonzero(fresh)
        twice = (np.add.reduceat(times[order], new) > 1) if len(new) else np.zeros(0, bool)
        first, last, anchor = first[order][new], last[order][new], anchor[order][new]
        part = np.where(is_hot[anchor], -1, (scan.phrase[anchor].view(np.uint64) % np.uint64(ranges)).astype(np.int64))
        by = np.argsort(part, kind="stable")
        first, last, anchor, twice, part = first[by], last[by], anchor[by], twice[by], part[by]
        begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        bounds = np.append(begin, len(part))
        text, line = texts_of(scan.words, first, last + window)
        marks = np.stack([anchor - first, twice], axis=1).astype("<i4")
        return sent([shard] * len(begin), part[begin].tolist(), packed(text, line[bounds]), [marks[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])

    def sent(shard: list, part: list, words: list, marks: list) -> pa.Table:
        return pa.table({"shard": pa.array(shard, pa.int32()), "part": pa.array(part, pa.int64()), "words": pa.array(words, pa.binary()), "marks": pa.array(marks, pa.binary())})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words, marks in zip(*(batch.column(c).to_pylist() for c in ("shard", "words", "marks")), strict=True):
                s = Stretches([words], [marks], window)
                order, fresh = ordered(s.keys)
                new = np.flatnonzero(fresh)
                n = np.add.reduceat(s.times[order], new)
                yield batch_of(window=binary_keys(s.keys[order[new]]), shard=pa.array(np.full(len(new), shard, np.int32)), n=pa.array(n))
        release()

    packs = dealt(d.select("shard", "text", "times")).groupBy("shard").cogroup(repeated.groupBy("shard")).applyInArrow(releasing2(candidates), "shard int, part long, words binary, marks binary")

    packs = settle(packs)
    discard(seen, twice)
    cold, stay = packs.where("part >= 0"), packs.where("part < 0")  # a shard has one pack that stays

    def confirm(t: pa.Table) -> pa.Table:
        s = Stretches(t.column("words").to_pylist(), t.column("marks").to_pylist(), window)
        words, places = s.passages(recurring(s.keys, s.times))
        return pa.table({"shard": t.column("shard"), "words": pa.array(words, pa.binary()), "places": pa.array(places, pa.binary())})

    confirmed = cold.groupBy("part").applyInArrow(releasing(confirm), "shard int, words binary, places binary").where(F.octet_length("places") > 0)
    none = F.lit(None).cast("binary")
    confirmed = confirmed.select("shard", "words", "places", none.alias("marks"), none.alias("window"))
    if shards > hot_shards:
        found, twice = repeats_of(stay.mapInArrow(windows, "window binary, shard int, n long"), "window")
        found = salted_join(found, twice, "window", "size", ["shard"], 32)
        confirmed = confirmed.unionByName(stay.select("shard", "words", none.alias("places"), "marks", none.alias("window")))
        confirmed = confirmed.unionByName(found.select("shard", none.alias("words"), none.alias("places"), none.alias("marks"), "window"))

    def passages(t: pa.Table) -> tuple[list[bytes], list[bytes]]:
        """The packs of passages that came to a shard or are cut out of its own stretches, and the places of their anchors."""
        came = t.filter(pa.compute.is_valid(t.column("places")))
        words, places = came.column("words").to_pylist(), came.column("places").to_pylist()
        own, twice = t.filter(pa.compute.is_valid(t.column("marks"))), t.filter(pa.compute.is_valid(t.column("window")))
        if own.num_rows and twice.num_rows:
            s = Stretches(own.column("words").to_pylist(), own.column("marks").to_pylist(), window)
            known = np.frombuffer(b"".join(twice.column("window").to_pylist()), _KEY)
            weight = np.concatenate([np.zeros(len(s.keys), np.int64), np.full(len(known), 2)])
            more = s.passages(recurring(np.concatenate([s.keys, known]), weight)[: len(s.keys)])
            some = [(w, p) for w, p in zip(*more, strict=True) if p]
            words, places = words + [w for w, _ in some], places + [p for _, p in some]
        return words, places

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return result(None, [], [], [], [], [])
        left = rows_of(left)
        scan = Scan(column(left, "text"), window, phrase, anchors=False)
        covered = np.zeros(len(scan.hash) + 1, np.int64)
        words, places = passages(right)
        if words:
            passage = Words(lines_of(words)[0])
            places = np.concatenate([np.frombuffer(b, "<i4") for b in places]).astype(np.int64)
            for begin, end in occurrences(scan, passage, places, phrase):
                np.add.at(covered, begin, 1)
                np.subtract.at(covered, end, 1)
        gone = np.cumsum(covered[:-1]) > 0
        first = scan.words.first
        if tidy:
            kept = scan.words.texts(~gone)
        else:
            touched = np.add.reduceat(np.append(gone, False), first[:-1]) * (np.diff(first) > 0) > 0
            kept = scan.words.texts(~gone & touched[scan.row])
            kept = [k if t else x for k, t, x in zip(kept, touched.tolist(), left.column("text").to_pylist(), strict=True)]
        removed = np.concatenate([[0], np.cumsum(gone)])
        edge = np.r_[True, scan.row[1:] != scan.row[:-1]] if len(gone) else np.zeros(0, bool)
        begin = np.flatnonzero(gone & (edge | ~np.r_[False, gone[:-1]])) if len(gone) else np.zeros(0, np.int64)
        end = np.flatnonzero(gone & (np.r_[edge[1:], True] | ~np.r_[gone[1:], False])) + 1 if len(gone) else begin
        runs = np.searchsorted(begin, first)
        base = first[scan.row[begin]] if len(begin) else begin
        return result(left, np.diff(first), np.diff(removed[first]), kept, runs, (begin - base, end - base))

    confirmed_by = confirmed.groupBy("shard")
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, text string, removed array<struct<start: int, stop: int>>, times long").add("row", kind)
    out = dealt(d.select("doc_id", "text", "times", "row", "shard")).groupBy("shard").cogroup(confirmed_by).applyInArrow(releasing2(locate), schema)
    if repeats is not None:
        out = out.withColumn("times", F.explode(F.expr("sequence(1L, times)")))
    return out.drop("times")


def result(left: pa.Table | None, n_words, n_removed, kept, runs, spans) -> pa.Table:
    begin, end = spans if len(spans) else ([], [])
    pairs = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["start", "stop"])
    if left is None:  # Spark takes no rows without columns of the right kinds
        return pa.table({})
    lists = pa.ListArray.from_arrays(pa.array(runs if len(runs) else [0], pa.int32()), pairs)
    return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "text": pa.array([k if isinstance(k, bytes) else k.encode() for k in kept], pa.binary()).cast(pa.string()), "removed": lists, "times": left.column("times"), "row": left.column("row")})


def occurrences(scan: Scan, passages: Words, places: np.ndarray, phrase: int):
    """First words and ends of all stretches of documents, of a window or more, that agree with a passage around its anchor.

    places: for each passage how many of its words come before its anchor.
    """
    import ahocorasick

    own = passages.hashes()
    at = passages.first[:-1] + places
    alike = window_hashes(own, phrase, 2)[at]
    numbers = pa.array(np.concatenate([scan.hash, own])).dictionary_encode().indices.to_numpy().astype(np.int64)
    numbers, own = numbers[: len(scan.hash)], numbers[len(scan.hash) :]
    by = np.argsort(alike, kind="stable")  # passages of one anchor together
    begin = np.flatnonzero(np.r_[True, alike[by][1:] != alike[by][:-1]])
    size = np.diff(np.append(begin, len(by)))
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, a in enumerate(at[by[begin]].tolist()):
        machine.add_word(tuple(own[a : a + phrase].tolist()), k)
    machine.make_automaton()
    # An occurrence has words of phrases only, so the stream may leave out what lies between runs of such words.
    used = np.zeros(int(max(numbers.max(initial=0), own.max(initial=0))) + 1, bool)
    used[own[at[by[begin]][:, None] + np.arange(phrase)]] = True
    inside = np.concatenate([[False], used[numbers], [False]])
    edge = np.concatenate([[True], scan.row[1:] != scan.row[:-1], [True]])
    first = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
    stop = np.flatnonzero(inside[:-1] & (edge | ~inside[1:]))
    long = stop - first >= phrase
    ends: list[int] = []
    found: list[int] = []
    for a, b in zip(first[long].tolist(), stop[long].tolist(), strict=True):
        for e, k in machine.iter(tuple(numbers[a:b].tolist())):
            ends.append(a + e)
            found.append(k)
    hit, kind = np.array(ends, np.int64) - phrase + 1, np.array(found, np.int64)
    total = np.concatenate([[0], np.cumsum(size[kind])])
    low, high = scan.words.first[:-1][scan.row[hit]], scan.words.first[1:][scan.row[hit]]
    i = 0
    while i < len(hit):  # some hits at a time, each with all passages of its anchor
        j = max(i + 1, int(np.searchsorted(total, total[i] + _AT_ONCE, "right")) - 1)
        h = np.repeat(np.arange(i, j), size[kind[i:j]])
        p = by[begin[kind[h]] + np.arange(len(h)) - (total[h] - total[i])]
        left = _agree(numbers, own, hit[h], at[p], -1, np.minimum(places[p], hit[h] - low[h]))
        right = _agree(numbers, own, hit[h] + phrase - 1, at[p] + phrase - 1, 1, np.minimum(passages.first[1:][p] - at[p], high[h] - hit[h]) - phrase)
        some = left + phrase + right >= scan.window
        yield (hit[h] - left)[some], (hit[h] + phrase + right)[some]
        i = j


def _agree(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, step: int, most: np.ndarray) -> np.ndarray:
    """How many entries next to x[i] and y[j], in direction step, agree one by one; `most` bounds them."""
    out, live = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
    n = 1
    while len(live):
        live = live[x[i[live] + step * n] == y[j[live] + step * n]]
        out[live] = n
        n += 1
        live = live[most[live] >= n]
    return out
