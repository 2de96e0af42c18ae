"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is the sequence of its five-word shingles, each labelled with its occurrence number so that no two
are equal. Each of `tables` sketches takes the `sample` labelled shingles of least hash and keeps them in text
order: two documents share a sketch if they drew the same shingles in the same order, which depends on their
edit similarity. Documents of few shingles use sketches of `small_sample` instead.

Documents that share a sketch are candidates. A candidate pair is linked if an alignment of the two shingle
sequences matches m shingles in order with m / (n1 + n2 - m) >= `similarity`; matches farther off the diagonal
than the unmatched shingles this allows need not be looked at, hence the band. A class is a connected set of
linked documents.

Within a bucket (the documents of a sketch) pairs are never listed: all are compared with one leader. Those that
are not in its class then are compared with each other and with the members of its class, in squares of bounded
blocks, of which only links that join classes come out; a pair that shares several buckets is compared in one.
That holds for buckets of any size. Before texts are fetched, pairs are sieved by signatures, which bound the
similarity from above, in larger squares, so that a large bucket is copied fewer times.
Classes are found by star contraction in tables; nothing about all documents comes to the driver.

Defined cases: equal word sequences are one document from the start, so copies cost one sketch; texts without
words (null, empty or blank) are equal to each other and near nothing else; a text of fewer than five words has
one shingle of them all. Rows of equal doc_id and text are one document; while links are sought, a null doc_id and
one of several texts are replaced by a hash of both. Of a class the least doc_id stays, of repeated rows one. Columns besides doc_id and text
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import batch_of, discard, free_names, id_text, if_small, map_batches, salted_join, settle
from strandflow.llm.words import Words, constants, mix, window_hashes

_U = np.uint64
#: Bins of a signature, and deviations below the limit from which on a pair cannot be linked.
BINS, DEVIATIONS = 128, 5
#: Shingles that count as one more document when blocks are dealt out, so that long texts fill a block sooner.
_WEIGHT = 2048
#: Pairs whose sketches are compared at a time.
_PAIRS = 1 << 14


@dataclass(frozen=True)
class Sketching:
    """Of pairs just at similarity 0.8 about 1e-7 share none of their sketches: so many are missed, whatever the sizes of buckets."""

    shingle: int = 5
    similarity: Fraction = Fraction(4, 5)
    tables: int = 30
    sample: int = 4
    small_tables: int = 24
    small_sample: int = 2
    small: int = 20  # shingles up to which small sketches are used; up to small / similarity both are
    block: int = 256  # documents of a bucket that a task compares with each other or with another block
    refine: int = 4096  # documents of a bucket that a task sieves by signatures against each other or as many others


def shingles(words: Words, size: int) -> list[np.ndarray]:
    """The shingle hashes of each row; of a row with fewer words than that, one of all its words."""
    h = words.hashes()
    wide = window_hashes(h, size, 11)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(wide[a : b - size + 1])
        elif b > a:
            out.append(window_hashes(h[a:b], b - a, 13))
        else:
            out.append(h[:0])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles made different by their occurrence numbers."""
    order = np.argsort(s, kind="stable")
    fresh = np.r_[True, s[order][1:] != s[order][:-1]]
    if fresh.all():
        return mix(s)
    runs = np.flatnonzero(fresh)
    number = np.empty(len(s), np.uint64)
    number[order] = np.arange(len(s)) - np.repeat(runs, np.diff(np.append(runs, len(s))))
    return mix(s + number * _U(0x9E3779B97F4A7C15))


def least(x: np.ndarray, turns: np.ndarray, sample: int) -> np.ndarray:
    """For each of the orders `turns` the places of the `sample` least of x, in text order."""
    n = len(x)
    if n <= sample:
        return np.tile(np.arange(n), (len(turns), 1))
    if n > 64 * sample:
        found = _least_below(x, turns, sample, 8 * sample / n)
        if found is not None:
            return found
    places = np.argpartition(x[None, :] * turns[:, None], sample - 1, axis=1)[:, :sample]
    return np.sort(places, axis=1)


def _least_below(x: np.ndarray, turns: np.ndarray, sample: int, share: float) -> np.ndarray | None:
    """As least(), from the few values below a share of the range; None if some order has too few of them."""
    limit, out = _U(int(share * 2.0**64)), np.empty((len(turns), sample), np.int64)
    for t, turn in enumerate(turns):
        y = x * turn
        low = np.flatnonzero(y < limit)
        if len(low) < sample:
            return None
        out[t] = np.sort(low[np.argpartition(y[low], sample - 1)[:sample]]) if len(low) > sample else low
    return out


def sketch(x: np.ndarray, how: Sketching) -> np.ndarray:
    """The sketches of a document's labelled shingles, as 64-bit keys."""
    n, out = len(x), []
    if not n:
        return np.zeros(0, np.uint64)
    kinds = []
    if n > how.small:
        kinds.append((how.tables, how.sample, 21))
    if n <= how.small / how.similarity:
        kinds.append((how.small_tables, how.small_sample, 22))
    for tables, sample, seed in kinds:
        places = least(x, constants(tables, seed), sample)
        key = constants(tables, seed + 100).copy()
        for j in range(places.shape[1]):
            key = mix(key * _U(0x9FB21C651E98DF25) + x[places[:, j]])
        out.append(key)
    return np.concatenate(out)


def signature(x: np.ndarray) -> bytes:
    """In each of BINS equal parts of the range a byte of the least labelled shingle, 0 where there is none."""
    out = np.zeros(BINS, np.uint8)
    x = np.sort(x)
    part = (x >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.r_[True, part[1:] != part[:-1]][: len(x)]
    out[part[first]] = 1 + (x[first] % _U(255)).astype(np.uint8)
    return out.tobytes()


def likely(a: np.ndarray, b: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Whether signatures (rows of bytes) agree in as many bins as they do at the limit, less DEVIATIONS standard deviations.

    An alignment's similarity is at most the share of common labelled shingles, which is the share of bins that agree.
    """
    some = ((a | b) > 0).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    t = float(similarity)
    return same >= t * some - DEVIATIONS * np.sqrt(t * (1 - t) * some)


def likely_pairs(sig: np.ndarray, similarity: Fraction) -> np.ndarray:
    """likely() of each row with each."""
    some = (sig > 0).astype(np.float32)
    count = some.sum(axis=1)
    either = (count[:, None] + count - some @ some.T).astype(np.int64)
    if len(sig) <= 32:
        equal = (sig[:, None] == sig[None, :]).sum(axis=2)
    else:
        equal = np.zeros((len(sig), len(sig)), np.uint8)  # BINS is below 256
        for b in np.ascontiguousarray(sig.T):
            equal += b[:, None] == b[None, :]
    t, k = float(similarity), np.arange(BINS + 1)
    need = np.ceil(t * k - DEVIATIONS * np.sqrt(t * (1 - t) * k)).astype(np.int64)
    return equal >= (need + BINS - k)[either]  # bins that both lack are equal too


def bytes_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Signatures as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def aligned(a: np.ndarray, b: np.ndarray, similarity: Fraction) -> bool:
    """Whether some alignment matches m entries in order with m / (len(a) + len(b) - m) >= similarity."""
    total = len(a) + len(b)
    need = -(-similarity.numerator * total // (similarity.numerator + similarity.denominator))
    short = min(len(a), len(b))
    if short < need:
        return False
    same = a[:short] == b[:short]
    head = short if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    same = a[len(a) - short :][::-1] == b[len(b) - short :][::-1]
    tail = short if same.all() else int(same.argmin())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    need -= head + tail
    if need <= 0:
        return True
    if min(len(a), len(b)) < need:
        return False
    values, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    nx, ny = np.bincount(x, minlength=len(values)), np.bincount(y, minlength=len(values))
    if int(np.minimum(nx, ny).sum()) < need:
        return False
    band = len(a) + len(b) - 2 * need  # entries that may stay unmatched
    if int((nx * ny).sum()) <= 8 * (len(a) + len(b)):
        return _by_matches(x, y, band) >= need
    return _by_bits(x, y, nx * ny > 0, band) >= need


def _by_matches(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """The longest common subsequence within the band, from the list of matches."""
    places: dict[int, list[int]] = {}
    for j, v in enumerate(y.tolist()):
        places.setdefault(v, []).append(j)
    tails: list[int] = []
    for i, v in enumerate(x.tolist()):
        for j in reversed(places.get(v, ())):
            if -band <= i - j <= band:
                at = bisect_left(tails, j)
                if at == len(tails):
                    tails.append(j)
                else:
                    tails[at] = j
    return len(tails)


def _by_bits(x: np.ndarray, y: np.ndarray, shared: np.ndarray, band: int) -> int:
    """The same by bits of long integers, for sequences in which few values occur many times."""
    masks = {v: int.from_bytes(np.packbits(y == v, bitorder="little").tobytes(), "little") for v in np.flatnonzero(shared).tolist()}
    n = len(y)
    every = (1 << n) - 1
    reach, row = (1 << (2 * band + 1)) - 1, every
    for i, v in enumerate(x.tolist()):
        m = masks.get(v)
        if m is None:
            continue
        m &= reach << (i - band) if i >= band else reach >> (band - i)
        hit = row & m
        row = ((row + hit) | (row - hit)) & every
    return n - row.bit_count()


def placed_rows(docs: DataFrame, how: Sketching) -> DataFrame:
    """doc_id, of_text (a hash of doc_id and text), class_id, class_size and stay_text (of_text of a row that stays) of every row."""
    d = id_text(docs).withColumn("of_text", F.xxhash64("doc_id", "text"))

    def sketches(batch: pa.RecordBatch) -> pa.RecordBatch:
        import hashlib

        words = Words(batch.column("text"))
        marks = [labelled(s) if len(s) else s for s in shingles(words, how.shingle)]
        keys = [sketch(x, how).view(np.int64) for x in marks]
        same = [hashlib.sha256(t).digest() for t in words.texts()]
        own = {c: batch.column(c) for c in ("doc_id", "of_text")}
        return batch_of(**own, same=pa.array(same, pa.binary()), n=pa.array([len(x) for x in marks], pa.int32()), keys=pa.array(keys, pa.list_(pa.int64())), sig=pa.array(map(signature, marks), pa.binary()))

    rows = settle(map_batches(d, sketches, "doc_id long, of_text long, same binary, n int, keys array<long>, sig binary"))
    several_texts = rows.groupBy("doc_id").agg(F.min("of_text").alias("x"), F.max("of_text").alias("y")).where("doc_id is not null and x < y")
    several_texts = if_small(settle(several_texts.select(F.col("doc_id").alias("_several"))))

    def with_node(df: DataFrame) -> DataFrame:
        own = F.when(F.col("doc_id").isNull() | F.col("_several").isNotNull(), F.col("of_text")).otherwise(F.col("doc_id"))
        return df.join(several_texts, F.col("doc_id") == F.col("_several"), "left").withColumn("node", own).drop("_several")

    rows = with_node(rows)
    firsts = settle(rows.groupBy("same").agg(F.min("node").alias("node"), F.count("*").alias("copies")))
    own = rows.where("n > 0").join(firsts, ["same", "node"], "left_semi").dropDuplicates(["same", "node"])
    own = settle(own.select("node", "n", "keys", "sig"))
    roots = link(own, with_node(d).select("node", "text"), how)
    of_copy = settle(firsts.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("root"), "copies"))
    placed = settle(salted_join(rows.select("doc_id", "of_text", "same"), of_copy, "same", "copies", ["doc_id", "of_text"], 96).select("doc_id", "of_text", "root"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "of_text"))  # nulls last
    sizes = settle(placed.groupBy("root").agg(least.alias("first"), F.count("*").alias("class_size")).select("root", F.col("first.doc_id").alias("class_id"), F.col("first.of_text").alias("stay_text"), "class_size"))
    out = salted_join(placed, sizes, "root", "class_size", ["doc_id", "of_text"], 64)
    return out.select("doc_id", "of_text", "class_id", "class_size", "stay_text")


def near_classes(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size and kept of every row."""
    out = placed_rows(docs, how)
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("of_text") == F.col("stay_text"))
    cols = ("doc_id", "class_id", "class_size")
    keepers = out.where(stays).groupBy(*cols, "of_text").agg(F.count("*").alias("times"))
    keepers = keepers.select(*cols, F.explode(F.expr("transform(sequence(1L, times), i -> i = 1)")).alias("kept"))
    return out.where(~stays).select(*cols, F.lit(False).alias("kept")).unionByName(keepers)


def keep_one(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """The rows of docs that stay, with all their columns; rows of one doc_id and text go or stay together."""
    gone = placed_rows(docs, how).where(~F.col("doc_id").eqNullSafe(F.col("class_id")) | (F.col("of_text") != F.col("stay_text")))
    own, text, digest, left, of = free_names(docs, "id", "text", "hash", "gone", "of")
    gone = settle(gone.select(F.col("doc_id").alias(left), F.col("of_text").alias(of)).distinct())
    d = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = d.withColumn(digest, F.xxhash64(own, text))
    same = F.col(own).eqNullSafe(F.col(left)) & (F.col(digest) == F.col(of))
    return d.join(if_small(gone), same, "left_anti").drop(own, text, digest)


def link(own: DataFrame, texts: DataFrame, how: Sketching) -> DataFrame:
    """node and root of every document that is linked to another. own: node, n, keys and sig of each different text."""
    entries = own.select("node", F.explode("keys").alias("key"))
    leaders = entries.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("size"))
    leaders = settle(leaders.where("lead < last").drop("last"))
    buckets = settle(salted_join(entries, leaders, "key", "size", ["node"], 48).where("node != lead").select("key", "lead", "node"))
    links = verify(settle(buckets.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()), own, texts, how)
    roots = components(links)
    placed = settle(with_roots(buckets, roots, "node", "r").select("key", "node", "r"))
    mixed = placed.groupBy("key").agg(F.min("r").alias("x"), F.max("r").alias("y")).where("x < y")
    mixed = settle(with_roots(mixed.join(leaders, "key"), roots, "lead", "l").select("key", "l", "size"))
    entries = salted_join(placed, mixed, "key", "size", ["node"], 48).select("key", "node", "r", (F.col("r") != F.col("l")).alias("apart"))
    more = compare_rest(entries, own, texts, how)
    discard(leaders, buckets, placed)
    return roots if more.isEmpty() else components(links.unionByName(more))


def compare_rest(entries: DataFrame, own: DataFrame, texts: DataFrame, how: Sketching) -> DataFrame:
    """Links among the entries (key, node, r, apart) of buckets that no leader brought together.

    Entries that are apart from the leader's class are compared with all of the bucket, in squares of blocks of
    about `block` entries, each square a group, of which only links that join roots come out. Blocks of those
    apart come first; two blocks of the class are never compared. In a first pass over sketches and signatures
    squares keep only entries that may have a partner; for these the texts are fetched. In that pass a group holds
    the squares of about `refine` entries, so that a bucket of m entries is copied m / refine times.
    """
    wide = max(1, how.refine // how.block)  # blocks that are sieved together
    entries = settle(entries)
    nodes = settle(entries.select("node").distinct())
    table = F.expr(f"cast(array_position(keys, key) as int) - 1 + if(n > {how.small}, 0, {how.tables})")
    now = settle(entries.join(own.join(if_small(nodes), "node", "left_semi"), "node").withColumn("at", F.array(table)))
    weight = F.expr(f"1L + n div {_WEIGHT}")
    sizes = now.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.when(F.col("apart"), weight).otherwise(0)).alias("m"), F.sum(F.when(F.col("apart"), 0).otherwise(weight)).alias("k"), F.min("r").alias("x"), F.max("r").alias("y"))
    sizes = settle(sizes.where("x < y").drop("x", "y"))
    both = salted_join(now, sizes, "key", "size", ["node"], 56)
    both = both.withColumns({"outer": F.expr(f"cast((m + {how.block - 1}) div {how.block} as int)"), "inner": F.expr(f"cast((k + {how.block - 1}) div {how.block} as int)"), "turn": F.xxhash64("node", "key")})
    both = both.withColumn("block", F.expr("cast(if(apart, pmod(turn, outer), outer + pmod(turn, inner)) as int)"))
    own = F.expr(f"block div {wide}").cast("int")
    last = F.expr(f"(if(own * {wide} < outer, outer + inner, outer) - 1) div {wide}").cast("int")
    both = both.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    cols = ("key", "x", "y", "block", "node", "r", "n", "keys", "sig", "at")
    squares = both.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), *cols[3:], "outer")

    def sieve(t: pa.Table) -> pa.Table:
        block, outer = t.column("block").to_numpy(), t.column("outer")[0].as_py()
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        t = t.select(list(cols)).combine_chunks()
        rows = {b: np.flatnonzero(block == b) for b in np.unique(block).tolist()}
        found = [t.slice(0, 0)]
        for a, b in ((a, b) for a in rows for b in rows if a <= b and a < outer and (a // wide, b // wide) == (x, y)):
            square = t.take(np.concatenate([rows[a], rows[b]]) if a < b else rows[a])
            for c, v in ((1, a), (2, b)):
                square = square.set_column(c, cols[c], pa.array(np.full(square.num_rows, v, np.int32)))
            may = eligible(square, how)
            if may.any():
                found.append(square.filter(pa.array(may.any(axis=0) | may.any(axis=1))))
        return pa.concat_tables(found)

    kinds = dict(squares.dtypes)
    some = settle(squares.groupBy("key", "x", "y").applyInArrow(sieve, ", ".join(f"{c} {kinds[c]}" for c in cols)))
    used = wanted(texts, some.select("node"))

    def compare(t: pa.Table) -> pa.Table:
        node, root = (t.column(c).to_numpy() for c in ("node", "r"))
        may = eligible(t, how)
        seqs = [s for chunk in t.column("text").chunks for s in shingles(Words(chunk), how.shingle)]
        marks = [labelled(s) for s in seqs]  # what has no shingles has no sketches
        size, t_ = np.array([len(s) for s in seqs]), how.similarity
        values, flat = np.unique(np.concatenate(marks), return_inverse=True)
        first = np.cumsum(size) - size
        up: dict[int, int] = {}

        def find(i: int) -> int:
            while i in up:
                i = up[i]
            return i

        found = []
        for i in np.flatnonzero(may.any(axis=1)).tolist():
            has = np.zeros(len(values), bool)
            has[flat[first[i] : first[i] + size[i]]] = True
            common = np.add.reduceat(has[flat], first, dtype=np.int64)
            enough = common * (t_.denominator + t_.numerator) >= t_.numerator * (size[i] + size)
            for j in np.flatnonzero(may[i] & enough).tolist():
                a, b = find(int(root[i])), find(int(root[j]))
                if a != b and aligned(seqs[i], seqs[j], t_):
                    up[max(a, b)] = min(a, b)
                    found.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    links = settle(some.join(used, "node").groupBy("key", "x", "y").applyInArrow(compare, "a long, b long"))
    discard(entries, now, some)
    return links


def eligible(t: pa.Table, how: Sketching) -> np.ndarray:
    """Which pairs of a square (in its upper triangle) are to be compared in it.

    They have different roots, sizes and signatures that allow a link, and the square's bucket is the first that they
    share: `at` are the tables of the sketches by which its entries came together.
    """
    block, root, size = (t.column(c).to_numpy() for c in ("block", "r", "n"))
    n, sim = t.num_rows, how.similarity
    may = np.triu(np.ones((n, n), bool), 1) & (root[:, None] != root[None, :])
    if t.column("x")[0] != t.column("y")[0]:
        may &= block[:, None] != block[None, :]
    may &= np.minimum(size[:, None], size[None, :]) * sim.denominator >= np.maximum(size[:, None], size[None, :]) * sim.numerator
    if not may.any():
        return may
    may &= likely_pairs(bytes_of(t.column("sig")), sim)
    at = t.column("at")[0].as_py()
    table, has = np.zeros((n, at[-1] + 1), np.int64), np.zeros((n, at[-1] + 1), bool)
    for i in np.flatnonzero(may.any(axis=0) | may.any(axis=1)).tolist():
        a = 0 if size[i] > how.small else how.tables
        own = t.column("keys")[i].as_py()[: max(0, at[-1] + 1 - a)]
        table[i, a : a + len(own)], has[i, a : a + len(own)] = own, True
    first, second = np.nonzero(may)
    for k in range(0, len(first), _PAIRS):
        i, j = first[k : k + _PAIRS], second[k : k + _PAIRS]
        may[i, j] = ((table[i] == table[j]) & has[i] & has[j]).sum(axis=1) == len(at)
    return may


def wanted(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text, once each, of the nodes given."""
    return settle(texts.join(if_small(settle(nodes.distinct())), "node", "left_semi").dropDuplicates(["node"]))


def with_roots(df: DataFrame, roots: DataFrame, of: str, to: str) -> DataFrame:
    found = roots.select(F.col("node").alias(f"_{of}"), F.col("root").alias(to))
    return df.join(found, F.col(of) == F.col(f"_{of}"), "left").withColumn(to, F.coalesce(to, of)).drop(f"_{of}")


def verify(pairs: DataFrame, own: DataFrame, texts: DataFrame, how: Sketching) -> DataFrame:
    """The linked ones of the pairs a, b (a written table). A document may be a of any number of pairs."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("size"))
    leads = settle(sizes.join(own.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a"))
    both = salted_join(pairs, leads, "a", "size", ["b"], 240).join(own.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
    both = both.where(F.least("n_a", "n_b") * how.similarity.denominator >= F.greatest("n_a", "n_b") * how.similarity.numerator)

    def sieve(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = likely(bytes_of(batch.column("sig_a")), bytes_of(batch.column("sig_b")), how.similarity)
        return batch_of(a=batch.column("a"), b=batch.column("b")).filter(pa.array(keep))

    some = settle(map_batches(both.select("a", "b", "sig_a", "sig_b"), sieve, "a long, b long"))
    used = wanted(texts, some.select(F.explode(F.array("a", "b")).alias("node")))
    leads = some.groupBy("a").agg(F.count("*").alias("size")).join(used.withColumnRenamed("node", "a"), "a")
    both = salted_join(some, leads, "a", "size", ["b"], 1 << 30).join(used.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        xs, ys = (shingles(Words(batch.column(c)), how.shingle) for c in ("text", "text_b"))
        linked = [aligned(x, y, how.similarity) for x, y in zip(xs, ys, strict=True)]
        return batch_of(a=batch.column("a"), b=batch.column("b")).filter(pa.array(linked, pa.bool_()))

    links = settle(map_batches(both.select("a", "b", "text", "text_b"), compare, "a long, b long"))
    discard(some, used, pairs)
    return links


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its connected set), by alternating star contraction."""
    digest = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    edges = settle(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = settle(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = settle(small)
        discard(edges, large)
        now, edges = digest(small), small
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return settle(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots))
