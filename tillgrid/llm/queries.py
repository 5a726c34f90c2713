"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op11_alignment
from .centroids import OP12_SQL, op12_centroids
from .chosen_path import op13_chosen_path
from .decontaminate import op8_decontaminate
from .lines import op1_line_dedup
from .mtree import OP2_SQL, op2_mtree
from .packing import op4_packing
from .pii import op6_pii
from .quality import op5_quality
from .sharding import op9_sharding
from .simhash import op7_simhash
from .token_counts import op10_token_counts
from .warc import OP3_SQL, op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mtree": op2_mtree,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_sharding": op9_sharding,
    "op10_token_counts": op10_token_counts,
    "op11_alignment": op11_alignment,
    "op12_centroids": op12_centroids,
    "op13_chosen_path": op13_chosen_path,
}

ORACLE: dict[str, str] = {
    "op2_mtree": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op12_centroids": OP12_SQL,
}
