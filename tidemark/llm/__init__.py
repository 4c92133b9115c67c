"""Operators of a training-data pipeline.

Nothing outside this folder imports it (``corpus_pipeline.py`` aside, which
belongs to it); it can be deleted as a whole.
"""
