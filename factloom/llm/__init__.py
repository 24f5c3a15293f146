"""Operators of a training-data pipeline: scoring, joins, mixing, sharding.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; ``queries`` applies them to the tables.
"""
