"""Training-data operators for large text corpora, one module per operator.

Nothing else in the library imports this package; its queries are in ``queries.py``.
"""
