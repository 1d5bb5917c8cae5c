"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from vigilake.llm import chat, collocations, ctw, decontamination, language, permuterm, pivots, quality, secrets, sentencepieces, sharding, simhash, sql, toxicity
from vigilake.llm.common import read_table

QUERIES = {
    "op1_secret_scans": lambda spark, d: secrets.secret_digest(read_table(spark, d, "documents")),
    "op2_jump_sharding": lambda spark, d: sharding.shard_digest(read_table(spark, d, "documents")),
    "op3_decontamination": lambda spark, d: decontamination.contamination_digest(
        read_table(spark, d, "documents"), read_table(spark, d, "benchmark")
    ),
    "op4_context_tree_scores": lambda spark, d: ctw.score_digest(read_table(spark, d, "documents")),
    "op5_sentence_pieces": lambda spark, d: sentencepieces.piece_digest(read_table(spark, d, "documents")),
    "op6_language_id": lambda spark, d: language.language_digest(read_table(spark, d, "documents")),
    "op7_simhash_groups": lambda spark, d: simhash.simhash_digest(read_table(spark, d, "documents")),
    "op8_chat_repair": lambda spark, d: chat.chat_digest(read_table(spark, d, "conversations")),
    "op9_quality_votes": lambda spark, d: quality.quality_digest(read_table(spark, d, "documents")),
    "op10_toxicity_grades": lambda spark, d: toxicity.toxicity_digest(read_table(spark, d, "documents"), read_table(spark, d, "labels")),
    "op11_collocations": lambda spark, d: collocations.collocations(read_table(spark, d, "documents")),
    "op12_spelling_variants": lambda spark, d: permuterm.variant_groups(read_table(spark, d, "documents")),
    "op13_exact_top_k": lambda spark, d: pivots.top_k(read_table(spark, d, "embeddings")),
}

#: The others hash, train or repair, which SQL cannot express; the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_secret_scans": sql.secret_scans(),
    "op2_jump_sharding": sql.jump_sharding(),
    "op3_decontamination": sql.decontamination(),
    "op11_collocations": sql.collocation_ranks(),
    "op12_spelling_variants": sql.spelling_variants(),
    "op13_exact_top_k": sql.exact_top_k(),
}
