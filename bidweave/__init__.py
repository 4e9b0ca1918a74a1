"""Procurement analytics on Spark: matching open notices with the contracts they replace."""
