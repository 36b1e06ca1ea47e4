"""Retention analytics on Spark: from raw sales lines to ranked retention decisions."""
