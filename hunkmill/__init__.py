"""Change-set analytics on Spark: diffs in, reviewable patch plans and their metrics out."""
