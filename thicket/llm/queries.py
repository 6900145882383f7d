"""The queries of this subpackage: name -> function (spark, sf_dir), and their SQL where it can express them."""

from __future__ import annotations

from thicket.llm import contamination, mixing, phrases, substrings, vectors, warc
from thicket.llm.audio import op1_media_audio
from thicket.llm.contamination import op4_decontamination
from thicket.llm.licenses import op10_licenses
from thicket.llm.mixing import op9_mixing
from thicket.llm.neardup import op3_near_duplicates
from thicket.llm.phrases import op12_phrases
from thicket.llm.pitman_yor import op8_pitman_yor
from thicket.llm.quality import op2_quality
from thicket.llm.substrings import op5_substring_dedup
from thicket.llm.tokenfiles import op11_token_files
from thicket.llm.tokens import op6_token_counts
from thicket.llm.vectors import op13_vector_codes
from thicket.llm.warc import op7_warc

QUERIES = {
    "op1_media_audio": op1_media_audio,
    "op2_quality": op2_quality,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_decontamination": op4_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_mixing": op9_mixing,
    "op10_licenses": op10_licenses,
    "op11_token_files": op11_token_files,
    "op12_phrases": op12_phrases,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": contamination.ORACLE_SQL,
    "op5_substring_dedup": substrings.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op12_phrases": phrases.ORACLE_SQL,
    "op13_vector_codes": vectors.ORACLE_SQL,
}
