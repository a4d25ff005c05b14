"""Settings and the queries of the driver contract."""
