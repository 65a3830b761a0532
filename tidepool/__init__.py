"""Memory analytics on Spark: scoring, similarity, graph, text and streaming operators over DataFrames."""
