"""Training-data operators: language ID, decontamination, sharding, quality,
WARC, URL filtering, packing, language-model scoring, near-duplicates, chat formatting,
spelling variants and source divergence.

Nothing else in the library imports this subpackage.
"""
