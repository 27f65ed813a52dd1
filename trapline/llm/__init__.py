"""Operators for preparing training text at scale.

One module per operator; ``registry`` lists the queries that apply them to the
tables.  Nothing else in the library imports this subpackage.
"""
