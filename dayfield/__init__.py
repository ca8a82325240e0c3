"""dayfield: climate-based daylight analytics on Spark tables."""
