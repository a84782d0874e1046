"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import line_dedup, products
from .bpe import op5_bpe
from .decontaminate import op1_decontaminate
from .langid import op7_langid
from .line_dedup import op3_line_dedup
from .ngram_join import op4_ngram_join
from .products import op9_top_products
from .quality import op10_quality
from .sharding import op2_shard
from .substring import op6_substring_dedup
from .toxicity import op8_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_shard": op2_shard,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_bpe": op5_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_langid": op7_langid,
    "op8_toxicity": op8_toxicity,
    "op9_top_products": op9_top_products,
    "op10_quality": op10_quality,
}
ORACLES = {"op3_line_dedup": line_dedup.ORACLE, "op9_top_products": products.ORACLE}
