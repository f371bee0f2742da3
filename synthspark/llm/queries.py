"""Queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from .chat_formatting import OP1_SQL, op1_chat_formatting
from .common import table
from .decontamination import OP5_SQL, op5_decontamination
from .jaccard_join import OP3_SQL, op3_jaccard_join
from .language_id import op8_language_id
from .line_dedup import OP4_SQL, op4_line_dedup
from .merkle_manifest import OP12_SQL, op12_merkle_manifest
from .mixing import op6_mixing
from .personal_data import op10_personal_data
from .quality_rules import op2_quality_rules
from .repeated_bytes import op9_repeated_bytes
from .sharding import op7_sharding
from .spelling_variants import OP13_SQL, op13_spelling_variants
from .substring_dedup import OP11_SQL, op11_substring_dedup


def queries() -> dict:
    return {
        "op1_chat_formatting": lambda spark, d: op1_chat_formatting(table(spark, d, "conversations")),
        "op2_quality_rules": lambda spark, d: op2_quality_rules(table(spark, d, "documents"), table(spark, d, "labels")),
        "op3_jaccard_join": lambda spark, d: op3_jaccard_join(table(spark, d, "documents")),
        "op4_line_dedup": lambda spark, d: op4_line_dedup(table(spark, d, "documents")),
        "op5_decontamination": lambda spark, d: op5_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op6_mixing": lambda spark, d: op6_mixing(table(spark, d, "documents")),
        "op7_sharding": lambda spark, d: op7_sharding(table(spark, d, "documents")),
        "op8_language_id": lambda spark, d: op8_language_id(table(spark, d, "documents")),
        "op9_repeated_bytes": lambda spark, d: op9_repeated_bytes(table(spark, d, "documents")),
        "op10_personal_data": lambda spark, d: op10_personal_data(table(spark, d, "documents")),
        "op11_substring_dedup": lambda spark, d: op11_substring_dedup(table(spark, d, "documents")),
        "op12_merkle_manifest": lambda spark, d: op12_merkle_manifest(table(spark, d, "documents")),
        "op13_spelling_variants": lambda spark, d: op13_spelling_variants(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": OP1_SQL,
        "op3_jaccard_join": OP3_SQL,
        "op4_line_dedup": OP4_SQL,
        "op5_decontamination": OP5_SQL,
        "op11_substring_dedup": OP11_SQL,
        "op12_merkle_manifest": OP12_SQL,
        "op13_spelling_variants": OP13_SQL,
    }
