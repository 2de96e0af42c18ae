import random

import pyspark.sql.functions as F

import public_tokenizers
from strandflow.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["a", "b", " ", "  ", "'", "ll", "'s", "\n", "7", "é", "漢", "!", " the", " quick", "<|x|>", "\t"]


def edits_for(rnd, text, most):
    edits, at = [], 0
    for _ in range(rnd.randint(0, most)):
        start = rnd.randint(at, len(text))
        stop = min(len(text), start + rnd.choice([0, 0, 1, 2, 5, 40, 400]))
        edits.append((start, stop, "".join(rnd.choice(ALPHABET) for _ in range(rnd.choice([0, 1, 3, 20, 300])))))
        at = stop
        if at >= len(text):
            break
    return edits


def applied(text, edits):
    for start, stop, put in reversed(edits):
        text = text[:start] + put + text[stop:]
    return text


def test_trees_follow_sequences_of_edits():
    enc = bpe.encoder(RANKS)
    for seed in range(60):
        rnd = random.Random(seed)
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.choice([0, 3, 80, 900, 6000])))
        tree = token_counts.CountTree(text, enc)
        for turn in range(10):
            edits = edits_for(rnd, text, 6)
            text = applied(text, edits)
            if turn % 3 == 2:  # a stored tree goes on like one in memory
                tree = token_counts.CountTree(tree.text, enc, tree.pack())
            tree.edit(edits)
            fresh = token_counts.CountTree(text, enc)
            assert tree.text == text and tree.total == fresh.total and tree.pieces == fresh.pieces, (seed, turn, edits)
            assert tree.pack() == fresh.pack(), (seed, turn, edits)
            assert (tree.sums[1] == [len(enc.encode(text)) // 4, len(text), fresh.pieces]).all()


def test_many_edits_of_a_long_text_encode_little():
    enc = bpe.encoder(RANKS)
    text = "some words of a long text, " * 20_000
    tree = token_counts.CountTree(text, enc)
    again = tree.edit([(i, i + 4, "other") for i in range(0, len(text), 27_000)])
    assert again < 400 and tree.total == token_counts.CountTree(tree.text, enc).total


def test_tables_of_trees_are_edited_again(spark):
    docs = spark.createDataFrame([(1, "hello world, it's me"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    trees = token_counts.build_trees(docs, RANKS)
    put = F.expr("case when text is null then null when length(text) > 4 then array(struct(0 as start, 2 as stop, 'we' as put), struct(4 as start, 4 as stop, '!' as put)) else array(struct(0 as start, 0 as stop, 'new text' as put)) end")
    for _ in range(3):
        out = token_counts.apply_edits(trees.withColumn("edits", put), RANKS)
        trees = out.select("doc_id", "text", "tree")
    enc = bpe.encoder(RANKS)
    rows = out.collect()
    assert len(rows) == 4
    for r in rows:
        assert r.n_tokens_after == len(enc.encode(r.text)) // 4
    assert sorted(r.text for r in rows)[-1] == "wello wor!!!ld, it's me" or any("!!!" in r.text for r in rows)


def test_edits_that_cannot_be_applied(spark):
    cases = {
        "null edit": [None], "no start": [(None, 2, "x")], "no stop": [(1, None, "x")], "reversed": [(4, 2, "x")], "negative": [(-1, 2, "x")], "behind": [(3, 12, "x")],
        "overlap": [(0, 4, "x"), (3, 5, "y")], "out of order": [(6, 7, "x"), (1, 2, "y")], "good": [(0, 5, "we"), (5, 5, None)], "none": [], "null": None,
    }
    schema = "doc_id long, text string, name string, edits array<struct<start: int, stop: int, put: string>>"
    docs = spark.createDataFrame([(i, "hello world", name, edits) for i, (name, edits) in enumerate(cases.items())], schema)
    out = {r.doc_id: r for r in token_counts.count_after_edits(docs, RANKS, None).collect()}
    for i, name in enumerate(cases):
        r = out[i]
        if name in ("good", "none", "null"):
            assert r.error is None and r.text == ("we world" if name == "good" else "hello world") and r.n_edits == (2 if name == "good" else 0)
        else:
            assert r.error and r.text == "hello world" and (r.n_edits, r.n_reencoded) == (0, 0) and r.n_tokens_after == r.n_tokens
    null = spark.createDataFrame([(1, None, [(0, 1, "x")]), (2, "", [(0, 0, "new")])], "doc_id long, text string, edits array<struct<start: int, stop: int, put: string>>")
    assert sorted((r.text, bool(r.error)) for r in token_counts.count_after_edits(null, RANKS, None).collect()) == [("", True), ("new", False)]
