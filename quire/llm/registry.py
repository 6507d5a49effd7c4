"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from quire.llm import exact_dedup, language_id, neighbours, ngram_join, packing, secrets, sentencepiece_words, sharding, toxicity, warc

QUERIES = {"op1_warc": warc.query, "op2_secret_scans": secrets.query, "op3_toxicity": toxicity.query, "op4_best_fit_packing": packing.query, "op5_sentencepiece": sentencepiece_words.query, "op6_language_id": language_id.query, "op7_ngram_join": ngram_join.query, "op8_sharding": sharding.query, "op9_exact_dedup": exact_dedup.query, "op10_nn_descent": neighbours.query}
SQL = {"op1_warc": warc.SQL, "op2_secret_scans": secrets.SQL, "op7_ngram_join": ngram_join.SQL, "op9_exact_dedup": exact_dedup.SQL}
