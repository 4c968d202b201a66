"""Operators on DataFrames: features, likelihoods, statistics, sampling, simulation and fitting."""
