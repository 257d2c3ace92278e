"""The queries of this subpackage, by the name that the driver calls them."""

from __future__ import annotations

from tilewright.llm import bpe, lines, media, mixing, pii, quality, rules, shards, simhash, urls

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_simhash": simhash.op2_simhash,
    "op3_mixing": mixing.op3_mixing,
    "op4_bpe": bpe.op4_bpe,
    "op5_pii": pii.op5_pii,
    "op6_shards": shards.op6_shards,
    "op7_rules": rules.op7_rules,
    "op8_urls": urls.op8_urls,
    "op9_lines": lines.op9_lines,
    "op10_media": media.op10_media,
}

#: SQL for DuckDB where SQL can express a query.
ORACLES: dict[str, str] = {
    "op9_lines": lines.ORACLE,
}
