"""Queries of this subpackage, and SQL for those that SQL can express."""

from payguard.llm import chat, decontam, divergence, media, near_dup, packing, quality, secrets, sharding, substring, toxicity, vector_codes, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_media_columns": media.op2_media_columns,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_kd_sharding": sharding.op4_kd_sharding,
    "op5_packing": packing.op5_packing,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_hyperminhash": near_dup.op8_hyperminhash,
    "op9_quality_mil": quality.op9_quality_mil,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_warc": warc.op12_warc,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES = {
    "op1_chat_format": chat.ORACLE,
    "op4_kd_sharding": sharding.ORACLE,
    "op6_decontamination": decontam.ORACLE,
    "op8_hyperminhash": near_dup.ORACLE,
    "op10_substring_dedup": substring.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
