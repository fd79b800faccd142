"""Neuron-morphology analytics on Spark DataFrames."""
