"""Raster, vector-document and score-table analytics over whole corpora, on Spark DataFrames."""
