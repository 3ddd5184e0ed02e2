"""Operators for large-scale training-data preparation.

Ten operators (one module each), their registered queries in ``queries.py``
and small shared helpers in ``common.py``. Nothing else in the library imports
this subpackage.
"""
