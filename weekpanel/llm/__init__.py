"""Operators for training-data pipelines (filters, classifiers, deduplication,
packing, language-model scoring) on the ``documents`` and ``pages`` tables."""
