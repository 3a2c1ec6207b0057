"""Operators of a training-data pipeline.

Nothing outside this folder imports it, apart from the guarded hook in
``__spark_entry__`` and ``corpus_pipeline``.
"""
