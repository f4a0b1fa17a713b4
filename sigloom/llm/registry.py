"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from sigloom.llm import decontaminate, embeddings, licences, lm, minhash, packing, periodic, pieces, quality, secrets, tokenout, toxicity, whitening

QUERIES = {
    "op1_token_output": tokenout.op1_token_output,
    "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
    "op3_licence_scans": licences.op3_licence_scans,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_embedding_near_dedup": embeddings.op6_embedding_near_dedup,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}
SQL = {"op9_benchmark_decontamination": decontaminate.OP9_SQL}
