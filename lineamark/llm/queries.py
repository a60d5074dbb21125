"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from lineamark.llm.langid import op4_language_id
from lineamark.llm.ngram_join import OP7_SQL, op7_ngram_join
from lineamark.llm.packing import op1_pack
from lineamark.llm.pii import op8_pii
from lineamark.llm.quality_model import op3_quality
from lineamark.llm.quality_rules import OP10_SQL, op10_quality_rules
from lineamark.llm.sharding import OP6_SQL, op6_shard
from lineamark.llm.topk import OP2_SQL, op2_top_k
from lineamark.llm.transducer import op5_bpe
from lineamark.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    f.__name__: f for f in (
        op1_pack,
        op2_top_k,
        op3_quality,
        op4_language_id,
        op5_bpe,
        op6_shard,
        op7_ngram_join,
        op8_pii,
        op9_warc,
        op10_quality_rules,
    )
}
SQL = {"op2_top_k": OP2_SQL, "op6_shard": OP6_SQL, "op7_ngram_join": OP7_SQL, "op9_warc": OP9_SQL, "op10_quality_rules": OP10_SQL}
