"""The queries of this subpackage and their SQL, for the driver's contract."""

from __future__ import annotations

import corpus_pipeline
from parcelworks.llm import embedding_dedup, fill_in_middle, hard_negatives, line_crf, line_dedup, mixing, quality, secrets, sentencepiece_nbest, simhash, token_counts, token_files, url_filter

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_sentencepiece": sentencepiece_nbest.op2_sentencepiece,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_line_quality": line_crf.op5_line_quality,
    "op6_token_files": token_files.op6_token_files,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality": quality.op8_quality,
    "op9_simhash": simhash.op9_simhash,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_embedding_dedup": embedding_dedup.OP4_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
