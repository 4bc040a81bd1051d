"""The queries of this subpackage's operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import ann, html, lm, media, mixing, near, packing, quality, runs, secrets, sharding, variants, warc

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_packing": packing.op2_packing,
    "op3_media": media.op3_media,
    "op4_html": html.op4_html,
    "op5_sharding": sharding.op5_sharding,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality": quality.op7_quality,
    "op8_ann": ann.op8_ann,
    "op9_near_dedup": near.op9_near_dedup,
    "op10_warc": warc.op10_warc,
    "op11_runs": runs.op11_runs,
    "op12_variants": variants.op12_variants,
    "op13_secrets": secrets.op13_secrets,
}
SQL = {
    "op5_sharding": sharding.sql(),
    "op6_mixing": mixing.SQL.replace("{docs}", "documents"),
    "op9_near_dedup": near.SQL,
    "op10_warc": warc.SQL,
    "op12_variants": variants.sql(),
}
