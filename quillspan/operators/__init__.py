"""Dataflow operators on DataFrames: corpora, retrieval, graphs, statistics, merges and budgets."""
