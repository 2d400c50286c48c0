"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import align, bpe, chat, decontaminate, exact_dedup, langid, lm, merkle, near_dedup, pii, quality, sharding, simhash


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_shards": sharding.op2_shards,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality": quality.op4_quality,
    "op5_pii": pii.op5_pii,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_lm": lm.op7_lm,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_langid": langid.op9_langid,
    "op10_chat": chat.op10_chat,
    "op11_merkle": merkle.op11_merkle,
    "op12_simhash": simhash.op12_simhash,
    "op13_align": align.op13_align,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op10_chat": chat.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
}
