"""Operators that prepare text corpora for language-model training.

Nothing outside this folder imports it; ``queries`` holds what
``__spark_entry__.py`` registers.
"""
