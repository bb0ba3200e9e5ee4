"""Training-data operators: one module each, plus the queries that apply them.

Nothing outside this package imports it; it can be removed as a whole.
"""
