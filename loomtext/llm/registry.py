"""Queries of this subpackage: name -> function (spark, sf_dir), and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, license_scan, mixing
from .embedding_dedup import op8_embedding_dedup
from .language_id import op10_language
from .license_scan import op9_licenses
from .mixing import op6_mixing
from .pii_spans import op2_pii
from .quality_gam import op4_quality
from .sentencepiece_dropout import op3_sentencepiece
from .simhash_dedup import op1_simhash
from .suffix_tree_lm import op7_suffix_tree
from .syncmers import op5_syncmers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality": op4_quality,
    "op5_syncmers": op5_syncmers,
    "op6_mixing": op6_mixing,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_licenses": op9_licenses,
    "op10_language": op10_language,
}

ORACLES: dict[str, str] = {"op6_mixing": mixing.ORACLE, "op8_embedding_dedup": embedding_dedup.ORACLE, "op9_licenses": license_scan.oracle()}
