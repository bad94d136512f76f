"""Streaming: intentionally empty.

The analysed workload has no streams, watermarks, event-time windows or late
data — every input is a file read once (SURVEY §2.12). Nothing is built here.
The regression sufficient statistics (``operators.ols.sufficient_stats``) are
mergeable, so an incremental ``foreachBatch`` upkeep could be added if a
streaming source ever appears; it is not part of this library today.
"""
