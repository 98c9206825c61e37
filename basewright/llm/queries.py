"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from basewright.llm import decontaminate, linededup, lmscore, media, minhash, packing, pii, preference, quality, resample, sigtree, toxicity, trie
from basewright.llm.shingles import components_sql


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_quality": quality.op1_quality,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_media": media.op4_media,
        "op5_lmscore": lmscore.op5_lmscore,
        "op6_preference": preference.op6_preference,
        "op7_surrogates": pii.op7_surrogates,
        "op8_minhash": minhash.op8_minhash,
        "op9_linededup": linededup.op9_linededup,
        "op10_packing": packing.op10_packing,
        "op11_resample": resample.op11_resample,
        "op12_trie": trie.op12_trie,
        "op13_sigtree": sigtree.op13_sigtree,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op2_decontaminate": decontaminate.ORACLE, "op6_preference": preference.ORACLE, "op11_resample": resample.ORACLE, "op12_trie": trie.ORACLE}
    out |= {"op8_minhash": components_sql(4, True), "op13_sigtree": components_sql(5, False)}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
