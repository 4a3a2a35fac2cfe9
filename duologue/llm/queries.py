"""The queries and DuckDB statements of the training-data operators."""

from __future__ import annotations

from duologue.llm import ann, decontam, linededup, packing, secrets, simhash, substring, toxicity, urlfilter, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_packing": packing.op2_packing,
    "op3_warc_revisits": warc.op3_warc_revisits,
    "op4_ann": ann.op4_ann,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_secrets": secrets.op8_secrets,
    "op9_substring_dedup": substring.op9_substring_dedup,
    "op10_url_filter": urlfilter.op10_url_filter,
    "op6_seed_counts": decontam.op6_seed_counts,
    "op8_base_patterns": secrets.op8_base_patterns,
}
SQL = {
    "op3_warc_revisits": warc.SQL,
    "op7_line_dedup": linededup.SQL,
    "op9_substring_dedup": substring.SQL,
    "op10_url_filter": urlfilter.SQL,
    "op4_ann": ann.SQL,
    "op6_seed_counts": decontam.SQL,
    "op8_base_patterns": secrets.SQL,
}
