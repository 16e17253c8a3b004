"""The operators' queries and their DuckDB SQL."""

from __future__ import annotations

from lumenfit.llm import chat, decontam, fingerprint, huffman, langid, licenses, neardup, packing, secrets, substrings

QUERIES = {
    "op1_fingerprint": fingerprint.op1_fingerprint,
    "op2_substrings": substrings.op2_substrings,
    "op3_packing": packing.op3_packing,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_secrets": secrets.op6_secrets,
    "op7_licenses": licenses.op7_licenses,
    "op8_language": langid.op8_language,
    "op9_token_file": huffman.op9_token_file,
    "op10_chat_format": chat.op10_chat_format,
}
#: Where SQL can express an operator and is quick enough on whole tables.
ORACLES: dict[str, str] = {"op2_substrings": substrings.SQL, "op4_decontaminate": decontam.SQL, "op10_chat_format": chat.SQL}
