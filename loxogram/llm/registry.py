"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .exact import OP5_SQL, op5_exact
from .langid import op1_langid
from .lpf import op9_lpf
from .packing import op10_pack
from .quality import op7_quality
from .sentspans import op3_spans
from .shards import op4_shards
from .simhash import op2_simhash
from .warc import OP6_SQL, op6_warc
from .winnow import OP8_SQL, op8_winnow

QUERIES = {"op1_langid": op1_langid, "op2_simhash": op2_simhash, "op3_spans": op3_spans, "op4_shards": op4_shards, "op5_exact": op5_exact, "op6_warc": op6_warc, "op7_quality": op7_quality, "op8_winnow": op8_winnow, "op9_lpf": op9_lpf, "op10_pack": op10_pack}

ORACLE_SQL: dict[str, str] = {"op5_exact": OP5_SQL, "op6_warc": OP6_SQL, "op8_winnow": OP8_SQL}
