"""Building blocks as Spark SQL expressions.

Each function takes an expression and returns an expression, as text.  Composed text is
parsed by Spark once, however many rules a table has, and serves DataFrames (``F.expr``),
SQL views, lambda bodies and streams alike.
"""
