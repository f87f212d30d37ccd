"""Operators for preparing training corpora at cluster scale.

Every module holds one operator with a general interface, the registered
``opN_<name>`` query that applies it to a whole table, and, where SQL can
express the result, the DuckDB text of that query.  Nothing outside this
package imports it.
"""
