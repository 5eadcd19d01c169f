"""The queries that this subpackage registers and their SQL."""

from __future__ import annotations

from folio.llm.bpe import op2_bpe
from folio.llm.chat import OP4_SQL, op4_chat
from folio.llm.divergence import OP11_SQL, op11_divergence
from folio.llm.fingerprints import op9_fingerprints
from folio.llm.interaction import OP12_SQL, op12_interaction
from folio.llm.langid import op1_langid
from folio.llm.mixing import op5_mixing
from folio.llm.neardup import op10_near_duplicates
from folio.llm.pii import op7_pii
from folio.llm.pitman_yor import op13_pitman_yor
from folio.llm.quality import OP3_SQL, op3_quality
from folio.llm.substrings import OP8_SQL, op8_substrings
from folio.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_langid": op1_langid,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_substrings": op8_substrings,
    "op9_fingerprints": op9_fingerprints,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_divergence": op11_divergence,
    "op12_interaction": op12_interaction,
    "op13_pitman_yor": op13_pitman_yor,
}
ORACLES: dict[str, str] = {"op3_quality": OP3_SQL, "op4_chat": OP4_SQL, "op6_warc": OP6_SQL, "op8_substrings": OP8_SQL, "op11_divergence": OP11_SQL, "op12_interaction": OP12_SQL}
