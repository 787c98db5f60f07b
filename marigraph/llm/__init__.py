"""Operators for preparing training text: nothing outside this folder imports it.

Each module holds one operator with a general interface, and a thin
``op<N>_<name>(spark, sf_dir)`` query that applies it to a whole table and
derives the digest columns of its contract.
"""
