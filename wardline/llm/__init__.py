"""Operations for large-scale training-data pipelines.

Self-contained: nothing outside this subpackage imports it, and it imports nothing from the rest of
the library, so it can be removed whole.
"""
