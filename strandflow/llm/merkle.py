"""A Merkle manifest of documents: each row a leaf, a tree for each source, a tree of the sources' roots, and a proof for each row.

A leaf is the SHA-256 of the fields doc_id, source, lang, n_chars and text, each `-` if it is null, else its number of bytes, a
colon and the value. A node is the SHA-256 of the hexadecimal digests of `ARITY` consecutive nodes of a level; the last of a level may have
fewer, even one. Levels are built until one node is left, which is the source's subroot; a single leaf is its own. Subroots in the order of
their sources (null first, then by bytes) make the tree of the root by the same rule. All that is shuffled is digests, never text.

The trees are combined by key, driven by nodes as they appear (`Parents`): a parent collects the digests of its children by their slots;
how many it needs follows from the number of leaves and its own place. When the last arrives the parent's digest is made, and is an event for
its parent in turn.

1. Leaves are sorted by ranges of source and doc_id, and counted, so that each knows its place. A source of any size is dealt over many ranges.
2. Each range combines what it has. Children whose parents still lack some, a few for each level at both ends of a source's run, are the frontier.
3. Frontiers are shuffled by the ancestor `STEP` levels above that they share and combined, so that one node of each of these
   is left, and so on until all roots are there. Each node keeps a reverse link: the ancestor that it became part of and the siblings on the way.
4. Links are followed from the roots back to the frontier of step 2, so that each of its nodes has the rest of its proof, and
   each range makes the proofs of its leaves from its own nodes and that rest.

A proof is the siblings' digests (32 bytes each), level by level from the leaf to the root, left to right within a level. Which side
they stand on follows from the places and counts (`position`, `n_leaves`, `source_position`, `n_sources`).

Defined cases: null fields are as above, an empty text is `0:`. Rows of equal doc_id are ordered by their leaves, a null doc_id comes first; rows that
are equal throughout are leaves of their own, in any order (their digests are the same; their proofs are those of their places). Long texts are hashed
where they stand. An empty table has no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandflow.llm.common import discard, map_batches, releasing, releasing2, settle

ARITY = 3
#: Levels that one round of combining frontiers rises: a task has the frontier nodes below one node of that height.
STEP = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(instead: dict[str, Column] | None = None) -> Column:
    """The digest (binary) of a row of documents, with other values of the fields named."""

    def field(name: str) -> Column:
        value = (instead or {}).get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(field, FIELDS)), 256))


def node(children: list[bytes]) -> bytes:
    return sha256(b"".join(children).hex().encode()).digest()


class Parents:
    """Nodes of one tree of n leaves, combined as their children come, up to the level `height` at most."""

    def __init__(self, n: int, height: int | None = None):
        self.widths = [n]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // ARITY))
        self.height = len(self.widths) - 1 if height is None else min(height, len(self.widths) - 1)
        self.partial: dict[tuple[int, int], dict[int, bytes]] = {}
        self.complete: dict[tuple[int, int], dict[int, bytes]] = {}
        self.done: dict[tuple[int, int], bytes] = {}

    def arity(self, level: int, parent: int) -> int:
        """Of a parent of nodes at this level."""
        return min(ARITY, self.widths[level] - ARITY * parent)

    def add(self, level: int, at: int, digest: bytes) -> None:
        while level < self.height:
            parent, slot = divmod(at, ARITY)
            children = self.partial.setdefault((level, parent), {})
            children[slot] = digest
            arity = self.arity(level, parent)
            if len(children) < arity:
                return
            self.complete[level, parent] = self.partial.pop((level, parent))
            digest = node([children[i] for i in range(arity)])
            level, at = level + 1, parent
        self.done[level, at] = digest

    def frontier(self) -> list[tuple[int, int, bytes]]:
        """level, place and digest of the nodes that became part of no other."""
        waiting = [(level, ARITY * parent + slot, d) for (level, parent), kids in self.partial.items() for slot, d in kids.items()]
        return waiting + [(level, at, d) for (level, at), d in self.done.items()]

    def link(self, level: int, at: int) -> tuple[int, int, list[bytes]]:
        """The frontier node above a node, and the siblings on the way to it."""
        siblings = []
        while (children := self.complete.get((level, at // ARITY))) is not None:
            siblings += [children[i] for i in range(len(children)) if i != at % ARITY]
            level, at = level + 1, at // ARITY
        return level, at, siblings


def fold(digest: bytes, proof: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that a leaf's digest and its proof give; places: place and number of leaves of each tree on the way."""
    used = 0
    for at, width in places:
        while width > 1:
            parent, slot = divmod(at, ARITY)
            others = min(ARITY, width - ARITY * parent) - 1
            run = [proof[used + 32 * i : used + 32 * i + 32] for i in range(others)]
            used += 32 * others
            digest = node([*run[:slot], digest, *run[slot:]])
            at, width = parent, -(-width // ARITY)
    return digest


_NODE = "tree string, n long, level int, at long, digest binary"


def _numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, digest and more) dealt by ranges: part is the number of the range, place a leaf's number in its tree within it."""
    dealt = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    names = leaves.columns

    def number(batches):
        from pyspark import TaskContext

        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            trees = batch.column("tree").to_pylist()
            place = np.empty(len(trees), np.int64)
            for i, tree in enumerate(trees):
                if tree != last:
                    last, count = tree, 0
                place[i] = count
                count += 1
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(trees), part, np.int32)), pa.array(place)], names=[*names, "part", "place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)
    return settle(dealt.mapInArrow(number, f"{fields}, part int, place long"))


def _starts(numbered: DataFrame) -> DataFrame:
    """part, tree, start (of the tree's leaves in this range) and n (of its leaves in all ranges)."""
    counts = numbered.groupBy("part", "tree").agg(F.count("*").alias("rows"))
    by = Window.partitionBy("tree")
    before = F.sum("rows").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("part", "tree", F.coalesce(before, F.lit(0)).alias("start"), F.sum("rows").over(by).alias("n"))


def _runs(leaves: pa.Table, starts: pa.Table):
    """The leaves of each tree of a range in the order of their places, with where they start and the number of all."""
    leaves = leaves.sort_by([("tree", "ascending"), ("place", "ascending")])
    trees = leaves.column("tree").combine_chunks().dictionary_encode()
    codes = (trees.combine_chunks() if isinstance(trees, pa.ChunkedArray) else trees).indices.to_numpy()
    edges = np.flatnonzero(np.diff(codes, prepend=-1)).tolist() + [len(codes)]
    where = {t: (s, n) for t, s, n in zip(*(starts.column(c).to_pylist() for c in ("tree", "start", "n")), strict=True)}
    for a, b in zip(edges, edges[1:], strict=False):
        run = leaves.slice(a, b - a)
        tree = run.column("tree")[0].as_py()
        yield (tree, run, *where[tree])


def _combined(run: pa.Table, start: int, n: int) -> Parents:
    parents = Parents(n)
    for i, digest in enumerate(run.column("digest").to_pylist()):
        parents.add(0, start + i, digest)
    return parents


def _frontier(numbered: DataFrame, starts: DataFrame) -> DataFrame:
    """The nodes of each range that became part of no other in it, with part and start."""
    schema = _NODE + ", part int, start long"

    def combine(leaves: pa.Table, starts: pa.Table) -> pa.Table:
        part, out = leaves.column("part")[0].as_py(), []
        for tree, run, start, n in _runs(leaves, starts):
            out += [(tree, n, *f, part, start) for f in _combined(run, start, n).frontier()]
        return _table(out, schema)

    return numbered.groupBy("part").cogroup(starts.groupBy("part")).applyInArrow(releasing2(combine), schema)


def _rise(nodes: DataFrame, height: int) -> DataFrame:
    """Each node with its link: the node at `height` (or the root below it) that it is part of, and the siblings on the way; `first`: of its link's nodes."""
    schema = "tree string, n long, level int, at long, up_level int, up_at long, up_digest binary, siblings binary, first boolean"
    rise = F.greatest(F.lit(0), F.lit(height) - F.col("level"))
    keyed = nodes.select("tree", "n", "level", "at", "digest", F.greatest("level", F.lit(height)).alias("top"), F.floor(F.col("at") / F.pow(F.lit(ARITY), rise)).alias("above"))

    def combine(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("tree", "n", "level", "at", "digest")), strict=True))
        parents = Parents(rows[0][1], group.column("top")[0].as_py())
        for _, _, level, at, digest in rows:
            parents.add(level, at, digest)
        ends = {(level, at): d for level, at, d in parents.frontier()}
        out, seen = [], set()
        for tree, n, level, at, _ in rows:
            *up, siblings = parents.link(level, at)
            out.append((tree, n, level, at, *up, ends[tuple(up)], b"".join(siblings), tuple(up) not in seen))
            seen.add(tuple(up))
        return _table(out, schema)

    return keyed.groupBy("tree", "top", "above").applyInArrow(releasing(combine), schema)


def _rest(frontier: DataFrame, height: int, levels: int) -> DataFrame:
    """The frontier's nodes with `top` (the tree's root) and `rest` (the siblings from the node to it)."""
    links, nodes = [], frontier.select("tree", "n", "level", "at", "digest")
    while True:
        links.append(settle(_rise(nodes, height)))
        if height >= levels:
            break
        nodes = links[-1].where("first").select("tree", "n", F.col("up_level").alias("level"), F.col("up_at").alias("at"), F.col("up_digest").alias("digest"))
        height += STEP
    found = links[-1].select("tree", "level", "at", F.col("up_digest").alias("top"), F.col("siblings").alias("rest"))
    for link in links[-2::-1]:
        above = found.withColumnsRenamed({"level": "up_level", "at": "up_at"})
        found = link.join(above, ["tree", "up_level", "up_at"]).select("tree", "level", "at", "top", F.concat("siblings", "rest").alias("rest"))
    return settle(frontier.select("part", "tree", "start", "n", "level", "at").join(found, ["tree", "level", "at"]))


def _proofs(numbered: DataFrame, rest: DataFrame, carried: list[str], more: list[str]) -> DataFrame:
    """carried columns of the leaves with position, n, top and proof, and more columns of `rest`, which go with the whole tree."""
    kinds = {f.name: f.dataType.simpleString() for f in (*numbered.schema, *rest.schema)}
    own = ["top", *more]
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*carried, *own]) + ", position long, n long, proof binary"

    def prove(leaves: pa.Table, rest: pa.Table) -> pa.Table:
        heads = rest.group_by("tree", use_threads=False).aggregate([(c, "min") for c in ("start", "n")])
        heads = heads.rename_columns({"start_min": "start", "n_min": "n"})
        tails = {(t, level, at): r for t, level, at, r in zip(*(rest.column(c).to_pylist() for c in ("tree", "level", "at", "rest")), strict=True)}
        whole = {t: values for t, *values in zip(*(rest.column(c).to_pylist() for c in ("tree", *own)), strict=True)}
        out = []
        for tree, run, start, n in _runs(leaves, heads):
            parents, proofs = _combined(run, start, n), []
            for at in range(start, start + run.num_rows):
                level, up, siblings = parents.link(0, at)
                proofs.append(b"".join(siblings) + tails[tree, level, up])
            cols = {c: run.column(c) for c in carried}
            cols |= {c: pa.array([v] * run.num_rows, _ARROW[kinds[c]]) for c, v in zip(own, whole[tree], strict=True)}
            cols |= {"position": pa.array(range(start, start + run.num_rows), pa.int64()), "n": pa.array([n] * run.num_rows, pa.int64()), "proof": pa.array(proofs, pa.binary())}
            out.append(pa.table(cols))
        return pa.concat_tables(out)

    return numbered.groupBy("part").cogroup(rest.groupBy("part")).applyInArrow(releasing2(prove), schema)


def _trees(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """leaves by ranges, and their frontier with the rest of the proofs."""
    numbered = _numbered(leaves, order)
    starts = settle(_starts(numbered))
    most, rows, ranges = starts.agg(F.max("n"), F.sum("n"), F.countDistinct("part")).first()
    levels = _level(most or 1)
    frontier = settle(_frontier(numbered, starts))
    out = numbered, _rest(frontier, min(_level(max((rows or 1) // max(ranges, 1), 1)) + STEP, levels), levels)
    discard(starts, frontier)
    return out


def _level(n: int) -> int:
    """Levels above n leaves."""
    level = 0
    while n > 1:
        n, level = -(-n // ARITY), level + 1
    return level


def manifest(docs: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, position, n_leaves, source_position, n_sources, proof of every row, and more columns."""
    kept = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), **(more or {})}
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))  # the null source comes first
    leaves = settle(docs.select(tree.alias("tree"), leaf_of().alias("digest"), F.monotonically_increasing_id().alias("row"), *(c.alias(n) for n, c in kept.items())))
    numbered, rest = _trees(leaves, ["doc_id", "digest", "row"])

    subroots = rest.select("tree", "top").groupBy("tree").agg(F.first("top").alias("digest"))
    tops = settle(subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("of")))
    upper = settle(_proofs(*_trees(tops, ["of"]), ["of"], []))
    upper = upper.select(F.col("of").alias("tree"), F.col("top").alias("root"), F.col("position").alias("source_position"), F.col("n").alias("n_sources"), F.col("proof").alias("onward"))
    # Of a source there are as many rows here as it has frontier nodes, a few for each range.
    rest = settle(rest.join(upper, "tree").withColumn("rest", F.concat("rest", "onward")).drop("onward"))
    discard(leaves, tops)
    out = _proofs(numbered, rest, ["digest", *kept], ["root", "source_position", "n_sources"])
    places = ["position", F.col("n").alias("n_leaves"), "source_position", "n_sources", "proof"]
    return out.select("doc_id", "source", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", *places, *(more or {}))


def verify(proven: DataFrame, candidate: str) -> DataFrame:
    """The manifest's rows with folded_root, which the digest in the column `candidate` and the row's proof give, and verified: whether it is the root."""
    names = proven.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = ("position", "n_leaves", "source_position", "n_sources", candidate, "proof")
        roots = [fold(digest, proof, [(at, n), (source, sources)]) for at, n, source, sources, digest, proof in zip(*(batch.column(c).to_pylist() for c in cols), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*names, "folded_root"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proven.schema)
    return map_batches(proven, run, f"{fields}, folded_root binary").withColumn("verified", F.col("folded_root") == F.col("root"))


_ARROW = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, _ARROW[t]) for (n, t), c in zip(fields, cols, strict=True)})
