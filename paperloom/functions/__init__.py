"""Builders of Spark SQL expressions: no I/O, no actions, no Python UDFs.

Each function takes and returns SQL text, to be used with ``F.expr`` or
``selectExpr``. The expressions are large but few; handing Spark one text costs
one call, where composing them from Column objects costs thousands.
"""
