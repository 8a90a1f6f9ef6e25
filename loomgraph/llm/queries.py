"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from corpus_pipeline import run as pipeline
from loomgraph.llm.html import op5_html_text
from loomgraph.llm.licenses import op4_license_scan
from loomgraph.llm.mixing import op8_source_mix
from loomgraph.llm.neardup import op3_near_duplicates
from loomgraph.llm.neighbours import op2_nearest_neighbours
from loomgraph.llm.packing import op10_best_fit_packing
from loomgraph.llm.quality import op1_quality_rules
from loomgraph.llm.suffixes import op7_suffix_dedup
from loomgraph.llm.toxicity import op9_toxicity
from loomgraph.llm.urls import OP6_SQL, op6_url_filter


def queries():
    return {f.__name__: f for f in (op1_quality_rules, op2_nearest_neighbours, op3_near_duplicates, op4_license_scan, op5_html_text, op6_url_filter, op7_suffix_dedup, op8_source_mix, op9_toxicity, op10_best_fit_packing)} | {"pipeline": pipeline}


def oracle_sql():
    return {"op6_url_filter": OP6_SQL}
