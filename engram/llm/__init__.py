"""Operators for preparing language-model training data at scale.

Nothing outside this folder (but corpus_pipeline.py) imports it.
"""
