"""Operations of a training-data pipeline, one module for each.

Nothing else in the package imports this subpackage; :mod:`casewright.llm.queries` holds its queries and SQL.
"""
