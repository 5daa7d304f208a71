"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from .chat import OP1_SQL, op1_chat
from .decontaminate import OP2_SQL, op2_decontaminate
from .embeddings import op7_embeddings
from .html_extract import op3_html
from .language import op4_language
from .packing import op8_pack
from .pii import op5_pii
from .simhash import op9_simhash
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .toxicity import op10_toxicity

QUERIES = {
    "op1_chat": op1_chat,
    "op2_decontaminate": op2_decontaminate,
    "op3_html": op3_html,
    "op4_language": op4_language,
    "op5_pii": op5_pii,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_embeddings": op7_embeddings,
    "op8_pack": op8_pack,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
}
ORACLES: dict[str, str] = {
    "op1_chat": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op6_substring_dedup": OP6_SQL,
}
