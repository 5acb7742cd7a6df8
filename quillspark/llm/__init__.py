"""Training-data operators.  Nothing outside this subpackage imports it.

``catalog.queries()`` and ``catalog.oracle_sql()`` hold what the entry module
registers; each operator has a module of its own with a general interface.
"""
