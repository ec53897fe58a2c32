"""Quernstone: corpus preparation and lexical evidence retrieval on Spark DataFrames."""
