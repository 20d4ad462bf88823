"""Operators of a training-data pipeline: packing, chat formatting,
fingerprints, cleaning, tokenizing, language, URL and licence models, corpus
language model and near-duplicate joins.  Nothing else in siteloom imports it."""
