"""Operators of a training-data pipeline, one module each, and the queries that apply them to the tables."""

from .exact import OP1_SQL, op1_exact_dedup
from .licences import op5_licence_scan
from .mixing import OP2_SQL, op2_mix_sources
from .negatives import OP13_SQL, op13_hard_negatives
from .packing import op10_pack
from .sharding import op6_kd_shards
from .simhash import op9_simhash
from .spelling import OP11_SQL, op11_spelling
from .substrings import op3_substrings
from .toxicity import op8_toxicity
from .urls import OP4_SQL, op4_url_filter
from .vectors import op7_vector_links
from .warc import OP12_SQL, op12_warc

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_substrings": op3_substrings,
    "op4_url_filter": op4_url_filter,
    "op5_licence_scan": op5_licence_scan,
    "op6_kd_shards": op6_kd_shards,
    "op7_vector_links": op7_vector_links,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_pack": op10_pack,
    "op11_spelling": op11_spelling,
    "op12_warc": op12_warc,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {
    "op1_exact_dedup": OP1_SQL, "op2_mix_sources": OP2_SQL, "op4_url_filter": OP4_SQL, "op11_spelling": OP11_SQL,
    "op12_warc": OP12_SQL, "op13_hard_negatives": OP13_SQL,
}
