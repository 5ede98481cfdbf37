"""The registered queries of this folder and their oracle SQL."""

from __future__ import annotations

from comparo.llm.backoff_lm import SQL as BACKOFF_SQL, op1_backoff_lm
from comparo.llm.collocations import SQL as COLLOCATIONS_SQL, op12_collocations
from comparo.llm.doubling_dedup import op4_doubling_dedup
from comparo.llm.jaccard_skip import op8_jaccard_skip
from comparo.llm.kd_sharding import op6_kd_tree_shards
from comparo.llm.nb_toxicity import op9_nb_toxicity
from comparo.llm.segment_topk import SQL as TOPK_SQL, op2_segment_topk
from comparo.llm.source_mix import op3_source_mix
from comparo.llm.suffix_merge import op7_suffix_merge
from comparo.llm.tables import ship
from comparo.llm.token_files import op13_bit_planes
from comparo.llm.token_links import op11_token_links
from comparo.llm.warc_derive import op10_warc_derivatives
from comparo.llm.wu_manber import op5_wu_manber


def _shipped(query):
    def run(spark, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {name: _shipped(query) for name, query in {
    "op1_backoff_lm": op1_backoff_lm,
    "op2_segment_topk": op2_segment_topk,
    "op3_source_mix": op3_source_mix,
    "op4_doubling_dedup": op4_doubling_dedup,
    "op5_wu_manber": op5_wu_manber,
    "op6_kd_tree_shards": op6_kd_tree_shards,
    "op7_suffix_merge": op7_suffix_merge,
    "op8_jaccard_skip": op8_jaccard_skip,
    "op9_nb_toxicity": op9_nb_toxicity,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_token_links": op11_token_links,
    "op12_collocations": op12_collocations,
    "op13_bit_planes": op13_bit_planes,
}.items()}

ORACLE: dict[str, str] = {
    "op1_backoff_lm": BACKOFF_SQL,
    "op2_segment_topk": TOPK_SQL,
    "op12_collocations": COLLOCATIONS_SQL,
}
