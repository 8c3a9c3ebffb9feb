"""Web access-log analytics on Spark: parse, roll up, report, stream."""
