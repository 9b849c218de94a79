"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from functools import wraps

from seasonlark.llm import (
    divergence_rules,
    latent_decontamination,
    license_scan,
    ordinal_toxicity,
    piece_lattice,
    polar_whitening,
    rule_ensemble,
    simhash_anchors,
    substring_cover,
    term_pipeline,
    token_shards,
    virtual_slots,
    wrapper_induction,
)

#: Rows of an Arrow batch: texts can be long, and a Python worker holds a batch or two.
BATCH_ROWS = 1000


def tuned(spark) -> None:
    """Small Arrow batches for tables of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _query(f):
    @wraps(f)
    def run(spark, sf_dir):
        tuned(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    own = [
        rule_ensemble.op1_rule_ensemble,
        latent_decontamination.op2_latent_decontamination,
        divergence_rules.op3_divergence_rules,
        ordinal_toxicity.op4_ordinal_toxicity,
        simhash_anchors.op5_simhash_anchors,
        substring_cover.op6_substring_cover,
        wrapper_induction.op7_wrapper_induction,
        license_scan.op8_license_scan,
        token_shards.op9_token_shards,
        piece_lattice.op10_piece_lattice,
        virtual_slots.op11_virtual_slots,
        polar_whitening.op12_polar_whitening,
        term_pipeline.op13_term_pipeline,
    ]
    return {f.__name__: _query(f) for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_cover": substring_cover.OP6_SQL, "op13_term_pipeline": term_pipeline.OP13_SQL}
