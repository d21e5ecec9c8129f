"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from spanforge.llm.audio import op7_audio
from spanforge.llm.bpe import op10_bpe
from spanforge.llm.divergence import ORACLE as DIVERGENCE_SQL
from spanforge.llm.divergence import op13_source_divergence
from spanforge.llm.hamming_search import ORACLE as HAMMING_SQL
from spanforge.llm.hamming_search import op2_hamming_search
from spanforge.llm.html_extract import op12_html_extraction
from spanforge.llm.importance import ORACLE as IMPORTANCE_SQL
from spanforge.llm.importance import op11_importance_resampling
from spanforge.llm.jaccard_join import op6_jaccard_join
from spanforge.llm.line_dedup import ORACLE as LINE_DEDUP_SQL
from spanforge.llm.line_dedup import op8_line_dedup
from spanforge.llm.packing import op3_packing
from spanforge.llm.pii import op5_pii
from spanforge.llm.suffix_dedup import op1_suffix_dedup
from spanforge.llm.toxicity import op4_toxicity
from spanforge.llm.warc import op9_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_hamming_search": op2_hamming_search,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_audio": op7_audio,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_html_extraction": op12_html_extraction,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_hamming_search": HAMMING_SQL,
    "op8_line_dedup": LINE_DEDUP_SQL,
    "op11_importance_resampling": IMPORTANCE_SQL,
    "op13_source_divergence": DIVERGENCE_SQL,
}
