"""Spark-native single-cell molecule and variant analytics, with training-data operators in ``cellweave.llm``."""
