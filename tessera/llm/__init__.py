"""Operators of a training-data pipeline: each module is one operator.

Nothing outside this subpackage imports it.  ``queries`` holds the driver
queries and their SQL.
"""
