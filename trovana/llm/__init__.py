"""Corpus-preparation operators for training data.

Each module holds one operator with a general interface; ``queries`` holds the
thin registered queries and their SQL. Nothing outside this subpackage imports it.
"""
