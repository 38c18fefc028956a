"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; deleting it leaves the rest of
:mod:`pulsegrid` intact.
"""
