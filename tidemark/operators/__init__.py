"""Factors, normalisers, combination, portfolios, simulation and metrics as DataFrame operators."""
