"""thistle: graph-pattern queries and knowledge-graph data processing on Spark DataFrames."""
