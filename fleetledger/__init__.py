"""Batch analytics over returnable-asset movement ledgers, built on Spark DataFrames."""
