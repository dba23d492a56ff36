"""Training-data operators for document corpora.

Each module holds one operator with its own general interface; ``queries`` has the
thin queries over the given tables. Nothing outside this package imports it.
"""
