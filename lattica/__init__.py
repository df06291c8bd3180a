"""Lattica: corpus curation, ontology and evaluation operators on Spark DataFrames."""
