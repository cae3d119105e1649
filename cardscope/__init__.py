"""Cardinality estimation lab on Spark: encoders, density models, plan analysis and the data preparation around them."""
