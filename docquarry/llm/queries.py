"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op10_bpe
from .decontamination import op6_decontamination
from .elkan_codes import OP13_SQL, op13_elkan_codes
from .jaccard_join import OP8_SQL, op8_jaccard_join
from .language_id import op2_language_id
from .line_dedup import op9_line_dedup
from .maxscore import OP5_SQL, op5_maxscore
from .projection_forest import op12_projection_forest
from .secrets import op4_secrets
from .token_counts import op3_token_counts
from .training_order import op7_training_order
from .turn_repair import op11_turn_repair
from .warc import OP1_SQL, op1_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_language_id": op2_language_id,
        "op3_token_counts": op3_token_counts,
        "op4_secrets": op4_secrets,
        "op5_maxscore": op5_maxscore,
        "op6_decontamination": op6_decontamination,
        "op7_training_order": op7_training_order,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_line_dedup": op9_line_dedup,
        "op10_bpe": op10_bpe,
        "op11_turn_repair": op11_turn_repair,
        "op12_projection_forest": op12_projection_forest,
        "op13_elkan_codes": op13_elkan_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op5_maxscore": OP5_SQL, "op8_jaccard_join": OP8_SQL, "op13_elkan_codes": OP13_SQL}
