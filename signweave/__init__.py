"""Signed-network balance analytics on Spark DataFrames."""
