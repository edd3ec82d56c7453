"""Queries of this subpackage, and the SQL that states the same results."""

from __future__ import annotations

from .chat import OP11_SQL, op11_chat_formatting
from .contamination import OP2_SQL, op2_decontamination
from .divergence import OP13_SQL, op13_source_divergence
from .langid import op1_language_id
from .lm import op9_lm_score
from .packing import op8_packing
from .quality import op4_quality
from .rules import op5_quality_rules
from .sharding import OP3_SQL, op3_sharding
from .simhash import op10_simhash
from .spelling import OP12_SQL, op12_spelling_variants
from .url_filter import op7_url_filter
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_lm_score": op9_lm_score,
    "op10_simhash": op10_simhash,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL = {"op2_decontamination": OP2_SQL, "op3_sharding": OP3_SQL, "op6_warc": OP6_SQL, "op11_chat_formatting": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_source_divergence": OP13_SQL}
