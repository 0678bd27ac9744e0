"""Language-constrained path queries over edge-labelled graphs, on Spark DataFrames."""
