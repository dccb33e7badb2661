"""Analyses over the sales fact. Each one takes DataFrames and returns a lazy DataFrame."""
