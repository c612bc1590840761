"""Training-data operators.

Nothing outside this subpackage imports it; ``catalog`` lists its queries and
their SQL.
"""
