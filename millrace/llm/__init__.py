"""Training-data operators: text quality, duplicates, leaks, secrets, tokens.

Nothing outside this subpackage imports it.
"""
