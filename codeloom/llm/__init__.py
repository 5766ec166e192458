"""Training-data operators: one module for each, their queries in queries.py.

Nothing outside this subpackage imports it.
"""
