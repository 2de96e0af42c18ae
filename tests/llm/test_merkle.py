"""The manifest against a plain restatement: levels as lists, proofs by slices."""

import zlib
from hashlib import sha256

import pytest

from strandflow.llm import merkle, queries

from .helpers import ROWS, SCHEMA, fixture


def h(*values):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def joined(nodes):
    return sha256("".join(nodes).encode()).hexdigest()


def tree(leaves):
    """The root, each leaf's siblings level by level, and a function that folds another leaf."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([joined(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])

    def proof(at):
        out = []
        for nodes in levels[:-1]:
            first = at // 3 * 3
            out.append(([*nodes[first:at]], [*nodes[at + 1 : first + 3]]))
            at //= 3
        return out

    return levels[-1][0], proof


def expected(rows):
    by_source = {}
    for r in rows:
        doc_id, text, lang, source, n_chars = r
        tampered = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, h(doc_id, source, lang, n_chars, text), h(doc_id, source, lang, n_chars, tampered), doc_id))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    root, top = tree([trees[s][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for at, (_, _, leaf, candidate, doc_id) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = trees[s][1](at) + top(i)
            folded = candidate
            for before, after in path:
                folded = joined([*before, folded, *after])
            proof = joined([d for before, after in path for d in before + after])
            out.append((doc_id, leaf, trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def found(spark, docs, tmp_path):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path))
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_awkward_rows(spark, tmp_path):
    docs = fixture(spark).withColumnRenamed("k", "n_chars")
    assert found(spark, docs, tmp_path) == expected([(a, b, c, d, 3) for a, b, c, d in ROWS])


@pytest.mark.parametrize("step", [1, 5])
def test_a_hot_source_over_many_ranges_and_rounds(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(merkle, "STEP", step)
    rows = [(i * 7 % 1000, f"text {i}\nof {i % 5}", "en", "hot" if i % 3 else f"s{i % 40}", 9) for i in range(700)]
    rows += [(5, "the same\n", "de", "hot", 9)] * 300
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
        assert found(spark, docs, tmp_path) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_rows_and_one_row(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA).withColumnRenamed("k", "n_chars")
    assert found(spark, empty, tmp_path / "none") == []
    one = [(1, "only\n", None, None, 5)]
    docs = spark.createDataFrame(one, "doc_id long, text string, lang string, source string, n_chars int")
    assert found(spark, docs, tmp_path / "one") == expected(one)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_parents_in_any_order_and_merged(n):
    import random

    leaves = [sha256(bytes([i])).digest() for i in range(n)]
    root, proof = tree([d.hex() for d in leaves])
    r = random.Random(n)
    order = list(range(n))
    r.shuffle(order)
    whole = merkle.Parents(n)
    for i in order:
        whole.add(0, i, leaves[i])
    assert [(d.hex()) for _, _, d in whole.frontier()] == [root]
    halves = [merkle.Parents(n), merkle.Parents(n)]
    for i in order:
        halves[r.random() < 0.5].add(0, i, leaves[i])
    merged = merkle.Parents(n)
    for half in halves:
        for at in half.frontier():
            merged.add(*at)
    assert [d.hex() for *_, d in merged.frontier()] == [root]
    for i in range(n):
        siblings = whole.link(0, i)[2]
        assert [s.hex() for s in siblings] == [d for a, b in proof(i) for d in a + b]
        assert merkle.fold(leaves[i], b"".join(siblings), [(i, n)]).hex() == root
