"""Publication-feed monitoring on Spark: matching, similarity, novelty and digests."""
