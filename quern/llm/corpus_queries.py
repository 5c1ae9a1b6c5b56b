"""The query opN_<name> of each operator, over its whole table with production parameters."""

from __future__ import annotations

from .decontaminate import op5_decontaminate
from .html_extract import op1_html_extraction
from .langid import op9_language_id
from .line_dedup import op6_line_dedup
from .ngram_join import op10_ngram_jaccard_join
from .oracles import OP5_SQL, OP7_SQL, OP10_SQL
from .packing import op2_best_fit_packing
from .pii import op3_pii
from .quality_crf import op4_quality_classifier
from .quality_rules import op7_quality_rules
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_pii": op3_pii,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

#: The others have no exact SQL form; tests/llm holds them against brute force.
ORACLES = {"op5_decontaminate": OP5_SQL, "op7_quality_rules": OP7_SQL, "op8_warc": OP8_SQL, "op10_ngram_jaccard_join": OP10_SQL}
