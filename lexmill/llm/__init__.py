"""Operations of a training-data pipeline: one module per operator, and the queries that apply them.

Nothing outside this subpackage imports it.
"""
