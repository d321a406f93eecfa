"""Operations for large-scale training-data preparation.

Nothing else in the library imports this subpackage. Every operator keeps a general interface; the thin registered
queries live in :mod:`genosieve.llm.queries`.
"""
