"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from corvane.llm.bpe_replay import op9_bpe
from corvane.llm.decontaminate import op10_decontaminate
from corvane.llm.embed_dedup import op2_embedding
from corvane.llm.html_extract import op8_html
from corvane.llm.line_dedup import OP3_SQL, op3_line_dedup
from corvane.llm.minhash_dedup import op6_minhash
from corvane.llm.quality_crf import op1_quality
from corvane.llm.sst_output import op7_sst_output
from corvane.llm.suffix_dedup import op5_suffix_dedup
from corvane.llm.token_rollup import op4_token_rollup

QUERIES = {
    "op1_quality": op1_quality,
    "op2_embedding": op2_embedding,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_rollup": op4_token_rollup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_minhash": op6_minhash,
    "op7_sst_output": op7_sst_output,
    "op8_html": op8_html,
    "op9_bpe": op9_bpe,
    "op10_decontaminate": op10_decontaminate,
}
ORACLES = {"op3_line_dedup": OP3_SQL}
