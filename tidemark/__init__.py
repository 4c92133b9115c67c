"""tidemark: versioned key-value analytics on Spark.

An ordered log of puts and deletes becomes consistent state: the newest
version of a key wins and tombstones are dropped last.  Everything is a pure
function from DataFrames to DataFrames; Catalyst picks the physical plan.
"""
