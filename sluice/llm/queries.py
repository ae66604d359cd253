"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chunks, conversations, dedup, media, mixing, ngrams, packing, pages, sharding, spelling, tokenfiles, toxicity, urls

_ALL = (media.op1_media_tiles, urls.op6_url_cascade, chunks.op7_chunk_fingerprint, mixing.op8_curriculum_mix, ngrams.op2_backoff_score, dedup.op3_minhash_dedup, packing.op4_bestfit_pack, pages.op5_template_extract, toxicity.op9_gru_toxicity, sharding.op10_lpt_shards, spelling.op11_spelling_forms, conversations.op12_conversation_repair, tokenfiles.op13_token_files)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {**urls.SQL, **mixing.SQL}
