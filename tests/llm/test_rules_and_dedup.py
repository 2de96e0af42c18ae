from collections import Counter
from hashlib import sha256

import duckdb
import pyspark.sql.functions as F

from strandflow.llm import exact_dedup, oracles, quality_rules, queries
from tests.llm.helpers import ROWS, collected, fixture, words


def restated(text):
    w, text = words(text), text or ""
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    cover = {j for i, x in enumerate(wins) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_counts_by_brute_force(spark, sf):
    docs = fixture(spark).unionByName(spark.read.parquet(f"{sf}/documents.parquet").drop("n_chars").withColumns({"digest": F.lit(""), "k": F.lit(1)}))
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    want = sorted(((i, *restated(t)) for i, t in rows), key=repr)
    got = collected(quality_rules.measure(docs).distinct(), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(set(got), key=repr) == sorted(set(want), key=repr)


def test_every_row_is_judged_and_small_groups_borrow_fences(spark):
    out = quality_rules.filter_documents(fixture(spark)).collect()
    assert len(out) == len(ROWS)
    assert all(r.base_failed for r in out if r.doc_id in (1, 2, 3, 12))
    assert not any(r.kept for r in out if r.base_failed)


def test_empty_table(spark):
    none = fixture(spark).limit(0)
    assert quality_rules.filter_documents(none).count() == 0
    assert exact_dedup.deduplicate(none).count() == 0


def test_rules_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(oracles.op1()).fetchall())
    assert sorted(tuple(r) for r in queries.op1_quality_rules(spark, sf).collect()) == want


def dedup_restated(rows):
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups, out, seen = {}, [], set()
    for i, t, *_ in rows:
        groups.setdefault(low(t), []).append(i)
    for i, t, *_ in rows:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        stays = i == keep and (low(t), i) not in seen
        seen.add((low(t), i))
        out.append((i, keep, len(ids), stays, sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_dedup_by_brute_force(spark):
    rows = [*ROWS, *((100 + i, "copy of ONE text" if i % 3 else "Copy of one text", "en", "a") for i in range(200))]
    out = exact_dedup.deduplicate(fixture(spark, rows)).withColumn("h", F.lower(F.hex("digest")))
    assert collected(out, "doc_id", "keep_id", "group_size", "kept", "h") == dedup_restated(rows)


def test_dedup_compares_text_when_digests_collide(spark):
    rows = [(i, f"text {i % 4}", "en", "a") for i in range(40)]
    out = exact_dedup.deduplicate(fixture(spark, rows), digest=F.substring("digest", 1, 0))
    want = sorted((i, 36 + i % 4, 10, i >= 36) for i in range(40))
    assert collected(out, "doc_id", "keep_id", "group_size", "kept") == sorted(want, key=repr)
