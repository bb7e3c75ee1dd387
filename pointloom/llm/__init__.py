"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries.py`` registers
one production query per operator; the operators themselves keep general
interfaces (column names, thresholds and seeds are parameters).
"""
