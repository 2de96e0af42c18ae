"""The tokenization automaton against merging by hand, its definition, and the library that reads the same file."""

import itertools
import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from strandflow.llm import automaton, queries

from .helpers import ROWS, SCHEMA, fixture

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def merged(word, merges):
    """Merges applied one after another to the whole word."""
    for u, v, w in merges:
        out = []
        for t in word:
            if out and out[-1] == u and t == v:
                out[-1] = w
            else:
                out.append(t)
        word = out
    return word


def gadgets(merges, letters):
    """The automaton with its arcs written out at every step: states as dicts of arcs, changed as the docstring says."""
    states = [{t: 0 for t in letters}]
    for u, v, w in merges:
        q = next((s[u] for s in states if u in s), None)
        if q is None or v not in states[q]:
            continue
        to = states[q][v]
        states.append({t: s for t, s in states[q].items() if t != v})
        copy = len(states) - 1
        for s in states:
            if u in s:
                s[w] = to
                s[u] = copy
    return states


def some_merges(seed):
    r, labels, merges = random.Random(seed), [b"a", b"b", b"c"], []
    while len(merges) < 9:
        u, v = r.randrange(len(labels)), r.randrange(len(labels))
        if labels[u] + labels[v] not in labels:
            merges.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
    return labels, merges


@pytest.mark.parametrize("seed", range(25))
def test_small_automata(seed):
    labels, merges = some_merges(seed)
    made = automaton.Automaton(labels, merges)
    for n in range(8):
        for word in itertools.product(range(3), repeat=n):
            want = merged(list(word), merges)
            assert made.encode_word(b"".join(labels[t] for t in word)) == want
            assert made.accepts(want)
            assert n == 0 or want == list(word) or not made.accepts(list(word))
    # The same language of tokens as with all arcs written out.
    full = gadgets(merges, range(3))
    pairs, seen = [(0, 0)], {(0, 0)}
    while pairs:
        a, b = pairs.pop()
        arcs = dict(made.arcs(a))
        assert arcs.keys() == full[b].keys()
        for t in arcs:
            if (nxt := (arcs[t], full[b][t])) not in seen:
                seen.add(nxt)
                pairs.append(nxt)


def test_refused_files():
    with pytest.raises(ValueError):
        automaton.Automaton([b"a", b"b", b"ab", b"aba"], [(2, 0, 3), (0, 1, 2)])
    with pytest.raises(ValueError):
        automaton.Automaton([b"a", b"aa", b"aaa"], [(0, 0, 1), (0, 1, 2), (1, 0, 2)])
    with pytest.raises(ValueError):
        automaton.Automaton([b"a"], []).encode_word(b"ab")


def test_as_the_library(library):
    made = automaton.compiled(FILE)
    words, r = automaton.Words(made), random.Random(3)
    alphabet = "aaabcdeeinthorsT \n'.-éß漢0019_\x85　"
    for i in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        if i % 9 == 0:
            text = text[:7] + "<|endoftext|>" * r.randint(1, 2) + text[7:]
        if i % 11 == 0:
            text += r.choice("ao=-*x") * r.randint(1, 300)
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(words.encode(text), "<u4").tolist()
        assert got == want
        assert made.decode(got) == library.decode(want, skip_special_tokens=False)
        ids = [r.randrange(50_300) for _ in range(6)]
        assert made.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_query(spark, tmp_path, library):
    rows = [*ROWS, (90, "a <|endoftext|> b<|endoftext|>", "en", "a"), (91, "=" * 30_000 + " ab" * 5000, "en", "a")]
    fixture(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_bpe_automaton"](spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table_null_ids_and_bytes_that_are_no_text(spark):
    made = automaton.compiled(FILE)
    assert automaton.encode_documents(spark.createDataFrame([], SCHEMA), made).count() == 0
    half = np.array(made.encode_word("é".encode()[:1]), "<u4").tobytes()
    ids = spark.createDataFrame([(1, None), (2, bytearray(half)), (3, bytearray())], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in automaton.decode_documents(ids, made).collect()}
    assert got == {1: "", 2: "�", 3: ""}
