"""The queries of this subpackage by name, and their SQL where SQL can say them."""

from __future__ import annotations

from .ann import op7
from .exact_dedup import OP3_SQL, op3
from .html_extract import op6
from .mixing import op5
from .near_dedup import op2
from .packing import op10
from .pii import op4
from .sharding import op8
from .toxicity import op9
from .url_filter import OP1_SQL, op1

QUERIES = {
    "op5_mixing": op5,
    "op7_ann": op7,
    "op6_html_extract": op6,
    "op1_url_filter": op1,
    "op4_pii": op4,
    "op2_near_dedup": op2,
    "op9_toxicity": op9,
    "op10_packing": op10,
    "op3_exact_dedup": op3,
    "op8_sharding": op8,
}

ORACLE = {
    "op1_url_filter": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
}
