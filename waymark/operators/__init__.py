"""Operators over DataFrames: spatial, names, catalog build, routes, journal, imports."""
