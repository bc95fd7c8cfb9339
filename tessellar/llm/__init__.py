"""Operators for training-data pipelines.

Nothing outside this folder (and ``corpus_pipeline.py`` and ``tests/llm``) imports it.
"""
