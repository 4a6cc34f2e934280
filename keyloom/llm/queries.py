"""The queries of this subpackage, one per operator, and their SQL. Queries base_opN_ are the columns of opN_
that the contract fixes and SQL can express."""

from __future__ import annotations

from . import audit, bands, decontam, html_extract, imatch, jaccard, license, oracle, packing, quality, repeats, repetition, secrets, sharding
from .common import table


def queries() -> dict:
    return {
        "op1_license_scan": lambda s, d: license.license_scan(table(s, d, "documents")),
        "op2_packing": lambda s, d: packing.pack(table(s, d, "documents")),
        "op3_sharding": lambda s, d: sharding.shard(table(s, d, "documents")),
        "op4_main_text": lambda s, d: html_extract.main_text(table(s, d, "pages")),
        "op5_repeats": lambda s, d: repeats.remove_repeats(table(s, d, "documents")),
        "op6_jaccard": lambda s, d: jaccard.jaccard_components(table(s, d, "documents")).select("doc_id", "n_shingles", "component_id"),
        "op7_secrets": lambda s, d: secrets.secret_scan(table(s, d, "documents")),
        "op8_decontamination": lambda s, d: decontam.decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
        "op9_imatch": lambda s, d: imatch.fingerprints(table(s, d, "documents")),
        "op10_quality": lambda s, d: quality.quality_scores(table(s, d, "documents"), table(s, d, "labels")),
        "op11_repetition": lambda s, d: repetition.quality_rules(table(s, d, "documents")),
        "op12_band_join": lambda s, d: bands.near_lines(table(s, d, "sale_lines"), table(s, d, "items")),
        "op13_filter_audit": lambda s, d: audit.audit(table(s, d, "documents"), table(s, d, "labels")),
        "base_op1_license_scan": lambda s, d: license.license_scan(table(s, d, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
        "base_op7_secrets": lambda s, d: secrets.secret_scan(table(s, d, "documents")).drop("spans"),
        "pipeline": pipeline,
    }


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict:
    return {"op5_repeats": oracle.REPEATS, "op6_jaccard": oracle.COMPONENTS, "base_op1_license_scan": oracle.LICENSES, "base_op7_secrets": oracle.SECRETS, "op11_repetition": oracle.RULES, "op12_band_join": oracle.BANDS, "op13_filter_audit": oracle.AUDIT}
