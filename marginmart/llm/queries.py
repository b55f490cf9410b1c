"""The subpackage's registered queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginmart.llm.backoff import OP7_SQL, op7_backoff, op7_backoff_order3
from marginmart.llm.bytebpe import op13_bytebpe
from marginmart.llm.chat import op8_chat
from marginmart.llm.decontam import op4_decontam
from marginmart.llm.filteraudit import OP11_SQL, op11_filters
from marginmart.llm.forest import op6_jaccard
from marginmart.llm.langid import op9_langid
from marginmart.llm.mtree import OP2_SQL, op2_mtree
from marginmart.llm.packing import op1_packing
from marginmart.llm.phrases import OP12_SQL, op12_phrases
from marginmart.llm.suffixes import op5_suffixes
from marginmart.llm.tokenfile import op3_token_files
from marginmart.llm.warc import OP10_SQL, op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mtree": op2_mtree,
    "op3_token_files": op3_token_files,
    "op4_decontam": op4_decontam,
    "op5_suffixes": op5_suffixes,
    "op6_jaccard": op6_jaccard,
    "op7_backoff": op7_backoff,
    "op7_backoff_order3": op7_backoff_order3,
    "op8_chat": op8_chat,
    "op9_langid": op9_langid,
    "op10_warc": op10_warc,
    "op11_filters": op11_filters,
    "op12_phrases": op12_phrases,
    "op13_bytebpe": op13_bytebpe,
}

ORACLE: dict[str, str] = {
    "op2_mtree": OP2_SQL,
    "op7_backoff": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op11_filters": OP11_SQL,
    "op12_phrases": OP12_SQL,
}
