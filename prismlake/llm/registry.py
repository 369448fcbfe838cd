"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from . import ann_tree, bayes_quality, bpe_lexicon, exact_dedup, feistel_pii, filter_audit, hmm_scoring, near_dedup, packing, prefix_tokens, secret_scan, spelling_variants, wavelet
from .common import Scratch, prepare, read_table


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        return query(prepare(spark), sf_dir)

    return run


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_ann_kmeans_tree(spark, sf_dir):
    result, said = ann_tree.nearest(read_table(spark, sf_dir, "embeddings"))
    return result.withColumn("calibrated_recall", F.lit(said.get("recall")).cast("double"))


def op3_hyperminhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_wavelet_token_shards(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return wavelet.read_documents(wavelet.write_shards(docs, Scratch(spark, "wavelet")))


def op5_grouping_ga_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents")).drop("ids")


def op6_randomness_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op7_bayes_quality(spark, sf_dir):
    return bayes_quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_feistel_pii(spark, sf_dir):
    return feistel_pii.pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key=feistel_pii.session_key(spark), counts=True)


def op9_lexicon_bpe(spark, sf_dir):
    return bpe_lexicon.round_trip(read_table(spark, sf_dir, "documents"))


def op10_hmm_scoring(spark, sf_dir):
    return hmm_scoring.score_documents(read_table(spark, sf_dir, "documents"))


def op11_prefix_token_counts(spark, sf_dir):
    return prefix_tokens.count_tokens(read_table(spark, sf_dir, "documents"))


def op12_parity_spelling_variants(spark, sf_dir):
    return spelling_variants.group_spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_filter_interaction_audit(spark, sf_dir):
    return filter_audit.audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries():
    return {f.__name__: _shipped(f) for f in (op1_exact_dedup, op2_ann_kmeans_tree, op3_hyperminhash_near_dedup, op4_wavelet_token_shards, op5_grouping_ga_packing, op6_randomness_secret_scan, op7_bayes_quality, op8_feistel_pii, op9_lexicon_bpe, op10_hmm_scoring, op11_prefix_token_counts, op12_parity_spelling_variants, op13_filter_interaction_audit)}


def oracle_sql():
    return {"op1_exact_dedup": exact_dedup.ORACLE_SQL, "op12_parity_spelling_variants": spelling_variants.ORACLE_SQL, "op13_filter_interaction_audit": filter_audit.ORACLE_SQL}
