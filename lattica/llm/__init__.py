"""Operators of a training-data pipeline: token counts, language-model scores, packing,
deduplication, decontamination, classifiers and nearest neighbours.

Nothing outside this folder imports it.
"""
