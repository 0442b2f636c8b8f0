"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame, the names of its columns and documented parameters; the queries of
``queries.py`` apply them to whole tables.
"""
