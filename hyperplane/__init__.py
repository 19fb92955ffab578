"""Kernel-machine analytics on Spark DataFrames."""
