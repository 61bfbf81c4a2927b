"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, codes, exact_dedup, infill, langid, mixing, pii, quality, simhash, substring, url_filter, vectors, winnow

QUERIES = {
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op10_bpe": bpe.op10_bpe,
    "op2_vectors": vectors.op2_vectors,
    "op6_langid": langid.op6_langid,
    "op3_quality": quality.op3_quality,
    "op8_substring": substring.op8_substring,
    "op1_pii": pii.op1_pii,
    "op9_mixing": mixing.op9_mixing,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_simhash": simhash.op5_simhash,
    "op11_infill": infill.op11_infill,
    "op12_codes": codes.op12_codes,
    "op13_decontaminate": winnow.op13_decontaminate,
}
ORACLES = {
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op11_infill": infill.ORACLE,
    "op12_codes": codes.ORACLE,
    "op13_decontaminate": winnow.ORACLE,
}
