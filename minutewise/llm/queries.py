"""The queries of this subpackage, by the names they are registered under, and the SQL of those that have some."""

from __future__ import annotations

from minutewise.llm.byte_bpe import op7_byte_bpe
from minutewise.llm.containment import OP4_SQL, op4_containment
from minutewise.llm.exact_dedup import OP11_SQL, op11_exact_dedup
from minutewise.llm.language import op10_language
from minutewise.llm.merkle import OP13_SQL, op13_merkle
from minutewise.llm.pii import op3_pii
from minutewise.llm.pitman_yor import op9_pitman_yor
from minutewise.llm.rabitq import OP2_SQL, op2_rabitq
from minutewise.llm.repair import op8_repair_ids
from minutewise.llm.simhash import op5_simhash
from minutewise.llm.spelling import OP12_SQL, op12_spelling
from minutewise.llm.toxicity import op1_toxicity
from minutewise.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_rabitq": op2_rabitq,
    "op3_pii": op3_pii,
    "op4_containment": op4_containment,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_repair_ids": op8_repair_ids,
    "op9_pitman_yor": op9_pitman_yor,
    "op10_language": op10_language,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_spelling": op12_spelling,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL = {
    "op2_rabitq": OP2_SQL,
    "op4_containment": OP4_SQL,
    "op6_warc": OP6_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op12_spelling": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
