"""Operators that prepare training text: each module is one operator with a general interface.

Nothing outside this subpackage imports it. ``queries`` registers each operator over its table.
"""
