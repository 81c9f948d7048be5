"""The queries of this subpackage and, where SQL can state them, their SQL for another engine."""

from __future__ import annotations

from .chat import op4_chat_formatting
from .jaccard import OP7_SQL, op7_ngram_jaccard
from .line_dedup import OP2_SQL, op2_line_dedup
from .neighbours import OP9_SQL, op9_nearest_neighbours
from .packing import op10_packing
from .pieces import op3_sentencepiece
from .quality import OP5_SQL, op5_quality_rules
from .secrets import op8_secret_scans
from .suffixes import op1_suffix_dedup
from .warc import OP6_SQL, op6_warc_archive

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc_archive": op6_warc_archive,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_secret_scans": op8_secret_scans,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_packing": op10_packing,
}
ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "op6_warc_archive": OP6_SQL,
    "op7_ngram_jaccard": OP7_SQL,
    "op9_nearest_neighbours": OP9_SQL,
}
