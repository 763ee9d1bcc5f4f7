"""Operators for preparing training text at corpus scale.

Each module holds one operator with its general interface; ``queries`` registers
the thin queries.  Nothing outside this folder imports it, apart from the guarded
import in ``__spark_entry__`` and the pipeline at the repository top.

Conventions shared by the operators: a null text counts as empty; only the id and
text (or url, source) columns that are named to an operator are read, so further
columns never clash with its own; operators that return documents keep the input
columns as they are.
"""
