"""Operators for large training-data pipelines (text, tokens, media, archives).

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only when the subpackage is present.
"""
