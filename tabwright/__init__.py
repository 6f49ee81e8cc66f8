"""Tabular profiling, label derivation, training, evaluation and scoring on Spark."""
