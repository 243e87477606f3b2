"""The text operators' queries and, where SQL can state them, their oracles."""

from __future__ import annotations

from tessera.llm import exact_dedup, fill_middle, mpeg_audio, near_dedup, ngram_trie, packing, pii, quality, resampling, secrets, sentencepiece_codec, sharding, toxicity

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_mpeg_audio": mpeg_audio.op3_mpeg_audio,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op10_quality": quality.op10_quality,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op7_lm_scoring": ngram_trie.op7_lm_scoring,
    "op9_pii_surrogates": pii.op9_pii_surrogates,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_sharding": sharding.op13_sharding,
}
ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE, "op8_minhash_near_dedup": near_dedup.ORACLE, "op11_fill_in_middle": fill_middle.ORACLE, "op12_importance_resampling": resampling.ORACLE}
