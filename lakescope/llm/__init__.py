"""Operators of a large-scale training-data pipeline, their queries and oracle SQL.

One module per operator; ``queries.py`` binds each to the whole of its table. Nothing else in the
library imports this subpackage.
"""
