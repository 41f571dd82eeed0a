"""A Spark-native engine for link graphs: crawl, build, rank, and rank again as the graph grows."""
