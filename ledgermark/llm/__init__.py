"""Operators for preparing training text: thirteen numbered operators and their queries.

Nothing else in the package imports this subpackage.
"""
