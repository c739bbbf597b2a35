"""The registered queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, language, packing, periodic, secrets, sharding, simhash, toxicity, trie, url_filter, vector_join, warc
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_latent_leaks": decontaminate.op1_latent_leaks,
    "op2_grid_order": vector_join.op2_grid_order,
    "op3_warc_revisits": warc.op3_warc_revisits,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_pack_pow2": packing.op5_pack_pow2,
    "op6_url_reputation": url_filter.op6_url_reputation,
    "op7_chat_format": chat.op7_chat_format,
    "op8_simhash": simhash.op8_simhash,
    "op9_toxic_segments": toxicity.op9_toxic_segments,
    "op10_interleave": sharding.op10_interleave,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_language_id": language.op13_language_id,
}
