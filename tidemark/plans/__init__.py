"""Strategies, parameter sweeps and reports composed of operators."""
