"""The star schema, marts, analytical queries, measures and the query catalogue."""
