"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.decontamination import OP13_SQL, op13_decontamination
from pagewright.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from pagewright.llm.fingerprints import op1_fingerprints
from pagewright.llm.language_id import op10_language_id
from pagewright.llm.license_scan import OP2_SQL, op2_license_scan
from pagewright.llm.lm_scoring import op4_lm_scoring
from pagewright.llm.merkle import OP11_SQL, op11_merkle_manifest
from pagewright.llm.mixing import op3_mixing
from pagewright.llm.near_dedup import op5_near_dedup
from pagewright.llm.packing import op6_packing
from pagewright.llm.pii import op8_pii
from pagewright.llm.topk_search import OP9_SQL, op9_topk_search
from pagewright.llm.warc_revisits import OP7_SQL, op7_warc_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_license_scan": op2_license_scan,
    "op3_mixing": op3_mixing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_near_dedup": op5_near_dedup,
    "op6_packing": op6_packing,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_pii": op8_pii,
    "op9_topk_search": op9_topk_search,
    "op10_language_id": op10_language_id,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_decontamination": op13_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": OP2_SQL,
    "op7_warc_revisits": OP7_SQL,
    "op9_topk_search": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_decontamination": OP13_SQL,
}
