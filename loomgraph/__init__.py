"""Symbol-graph analytics on Spark: files to nodes and edges, and queries over them."""
