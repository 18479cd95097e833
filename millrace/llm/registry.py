"""Queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import ORACLE_SQL as CHAT_SQL
from .chat import op1_chat
from .decontam import ORACLE_SQL as DECONTAM_SQL
from .decontam import op6_decontam
from .mixing import op9_mixing
from .orderminhash import op3_order_minhash
from .quality import op7_quality
from .secrets import op10_secrets
from .sharding import op5_sharding
from .simhash import op8_simhash
from .substrings import ORACLE_SQL as SUBSTRINGS_SQL
from .substrings import op2_substrings
from .toxicity import op4_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, over its whole table."""
    return {f.__name__: f for f in (op1_chat, op2_substrings, op3_order_minhash, op4_toxicity, op5_sharding, op6_decontam, op7_quality, op8_simhash, op9_mixing, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op1_chat": CHAT_SQL, "op2_substrings": SUBSTRINGS_SQL, "op6_decontam": DECONTAM_SQL}
