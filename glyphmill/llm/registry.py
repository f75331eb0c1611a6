"""What __spark_entry__.py adds when this package is present."""

from __future__ import annotations

from glyphmill.llm import oracles, queries, urls

QUERIES = queries.QUERIES
ORACLES = {
    "op1_topk": oracles.OP1,
    "op2_line_dedup": oracles.OP2,
    "op7_minhash": oracles.OP7,
    "op8_warc": oracles.OP8,
    "op11_blockjoin": oracles.OP11,
    "op12_prefix_trie": oracles.OP12,
    "op13_resampling": oracles.OP13,
    "op3_url_filter": oracles.op3(queries.URL_RULES, urls.WEIGHTS, urls.MIN_SOFT),
}
