"""Scholarly expertise analytics on Spark: records in, ranked expert profiles out."""
