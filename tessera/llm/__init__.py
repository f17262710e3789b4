"""Training-data operators (numbers 1 to 10) and their queries.

Nothing outside this subpackage imports it.
"""
