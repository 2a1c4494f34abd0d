"""Operators for preparing training data. Nothing else in the library imports this subpackage.

Every operator takes and returns DataFrames. The work on one text is a small function that runs inside Arrow
batches of a partition; what rows must share (counts, links, cells, candidates) goes through Spark's shuffles.
"""
