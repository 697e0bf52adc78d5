"""The operators' queries, and DuckDB SQL where it can express them."""

from __future__ import annotations

from lexis.llm.common import importable
from lexis.llm.embedding_dedup import OP6_SQL, op6_embedding_dedup
from lexis.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from lexis.llm.maxscore import OP7_SQL, op7_maxscore
from lexis.llm.mixing import op8_mixing
from lexis.llm.ngram_join import OP10_SQL, op10_ngram_join
from lexis.llm.outliers import op12_outliers
from lexis.llm.packing import op1_packing
from lexis.llm.ppm import op9_ppm
from lexis.llm.quality import op4_quality
from lexis.llm.span_dedup import OP3_SQL, op3_span_dedup
from lexis.llm.token_alignment import op11_token_alignment
from lexis.llm.token_orc import op5_token_orc
from lexis.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_span_dedup": op3_span_dedup,
    "op4_quality": op4_quality,
    "op5_token_orc": op5_token_orc,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_maxscore": op7_maxscore,
    "op8_mixing": op8_mixing,
    "op9_ppm": op9_ppm,
    "op10_ngram_join": op10_ngram_join,
    "op11_token_alignment": op11_token_alignment,
    "op12_outliers": op12_outliers,
    "op13_hard_negatives": op13_hard_negatives,
}
QUERIES = {name: importable(query) for name, query in QUERIES.items()}
ORACLE: dict[str, str] = {
    "op3_span_dedup": OP3_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op7_maxscore": OP7_SQL,
    "op10_ngram_join": OP10_SQL,
    "op13_hard_negatives": OP13_SQL,
}
