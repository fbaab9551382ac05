"""lexgraph: distributional and graph analysis of sequences as Spark DataFrames."""
