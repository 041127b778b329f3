"""The operators' queries, and SQL where it can express them."""

from __future__ import annotations

from . import chat_format, embedding_dedup, source_audit
from .byte_bpe import op12_byte_bpe
from .chat_format import op1_chat_format
from .embedding_dedup import op3_embedding_dedup
from .language_id import op8_language_id
from .lm_scoring import op6_lm_scoring
from .minhash_dedup import op9_minhash_dedup
from .mixing import op5_mixing
from .packing import op2_packing
from .quality_rules import op10_quality_rules
from .repair import op11_conversation_repair
from .secret_scan import op4_secret_scan
from .source_audit import op13_source_audit
from .training_order import op7_training_order

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_packing, op3_embedding_dedup, op4_secret_scan, op5_mixing, op6_lm_scoring, op7_training_order, op8_language_id, op9_minhash_dedup, op10_quality_rules, op11_conversation_repair, op12_byte_bpe, op13_source_audit)}
ORACLES = {"op1_chat_format": chat_format.ORACLE, "op3_embedding_dedup": embedding_dedup.ORACLE, "op13_source_audit": source_audit.ORACLE}
