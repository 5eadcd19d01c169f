"""The registered queries, one for each operator, and their SQL."""
