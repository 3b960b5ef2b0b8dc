"""Operators for preparing training text, each a Spark job over whole tables.

Nothing outside this subpackage imports it.
"""
