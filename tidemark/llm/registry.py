"""The registered queries of the corpus operators and their SQL twins."""

from tidemark.llm import ann, bpe, chat, fingerprints, mixing, near_dedup, quality, secrets, token_counts, toxicity

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_bpe_encoding": bpe.op3_bpe_encoding,
    "op4_mixing": mixing.op4_mixing,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_nearest_neighbours": ann.op10_nearest_neighbours,
}
ORACLE_SQL = {
    "op1_chat_formatting": chat.ORACLE_SQL,
    "op2_secret_scans": secrets.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op6_near_dedup": near_dedup.ORACLE_SQL,
}
