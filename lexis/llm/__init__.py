"""Training-data operators: one module per operator, plus small shared helpers.

Nothing outside this subpackage imports it.
"""
