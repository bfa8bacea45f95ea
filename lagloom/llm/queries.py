"""The registered queries of this folder."""

from __future__ import annotations

from lagloom.llm.cascade import OP11_SQL, op11_cascading_release
from lagloom.llm.collocations import OP12_SQL, op12_phrase_collocations
from lagloom.llm.decontaminate import OP3_SQL, op3_benchmark_decontamination
from lagloom.llm.html_text import op10_html_extraction
from lagloom.llm.language import op6_language_id
from lagloom.llm.minhash import op13_minhash_near_dedup
from lagloom.llm.packing import op4_best_fit_packing
from lagloom.llm.secrets import op8_secret_scans
from lagloom.llm.simhash import op5_simhash_near_dedup
from lagloom.llm.token_counts import op2_token_counts
from lagloom.llm.token_files import op1_token_files
from lagloom.llm.topk import OP7_SQL, op7_exact_topk
from lagloom.llm.toxicity import op9_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_token_counts,
        op3_benchmark_decontamination,
        op4_best_fit_packing,
        op5_simhash_near_dedup,
        op6_language_id,
        op7_exact_topk,
        op8_secret_scans,
        op9_toxicity,
        op10_html_extraction,
        op11_cascading_release,
        op12_phrase_collocations,
        op13_minhash_near_dedup,
    )
}

#: Where SQL can state a result. The others are tested against brute force in tests/llm.
ORACLE_SQL = {"op3_benchmark_decontamination": OP3_SQL, "op7_exact_topk": OP7_SQL, "op11_cascading_release": OP11_SQL, "op12_phrase_collocations": OP12_SQL}
