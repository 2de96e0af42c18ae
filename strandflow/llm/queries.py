"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import automaton, bpe, bpe_codec, divergence, exact_dedup, langid, merkle, oracles, order_minhash, packing, phrase_dedup, quality_model, quality_rules, token_counts, toxicity, training
from strandflow.llm.common import table

MULTI, ENGLISH = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"  # ENGLISH: the vocabulary of byte_bpe_50k.json as ranks
FILE = "byte_bpe_50k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.filter_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.tokenizer_file(MULTI)
    out = bpe_codec.decode_documents(bpe_codec.encode_documents(table(spark, sf_dir, "documents"), ranks), ranks)
    return out.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_after_edits(table(spark, sf_dir, "documents"), bpe.tokenizer_file(MULTI))
    return out.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pieces", "n_reencoded")


def op6_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), bpe.tokenizer_file(ENGLISH)))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(table(spark, sf_dir, "documents"))


def _held_out(rows: DataFrame, folds: int, part: int) -> DataFrame:
    return rows.withColumn("held_out", training.fold(F.col("doc_id"), folds) == part)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = _held_out(toxicity.score_documents(docs, model), toxicity.FOLDS, 0)
    return out.select("doc_id", "held_out", "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = _held_out(langid.predict_documents(docs, langid.fit(docs)), langid.FOLDS, langid.HELD_OUT)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    out = _held_out(quality_model.score_documents(docs, model), quality_model.FOLDS, quality_model.HELD_OUT)
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    out = merkle.verify(merkle.manifest(docs, {"candidate": merkle.leaf_of({"text": tampered})}), "candidate")
    proof = F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256")
    return out.select("doc_id", *(F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")), proof, F.lower(F.hex("folded_root")).alias("folded_root"), "verified")


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled = automaton.compiled(bpe.tokenizer_file(FILE))
    out = automaton.decode_documents(automaton.encode_documents(table(spark, sf_dir, "documents"), compiled), compiled)
    return out.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_exact_dedup, op3_bpe_codec, op4_token_counts, op5_order_minhash, op6_bestfit_packing,
        op7_toxicity, op8_language_id, op9_quality_classifier, op10_substring_dedup, op11_merkle_manifest, op12_bpe_automaton, op13_source_divergence,
    )
}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": oracles.op1(), "op2_exact_dedup": oracles.OP2, "op11_merkle_manifest": oracles.OP11, "op13_source_divergence": oracles.OP13}
