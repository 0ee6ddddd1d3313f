"""Operators for preparing text corpora: language ID, decontamination, quality
models and rules, deduplication, URL filters, token output and mixing.

Nothing outside this package imports it. ``entry`` holds the registered
queries; every operator has a module of its own with a general interface.
"""
