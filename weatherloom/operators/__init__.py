"""Operators on readings: rolling statistics, profiles, trends, norms, tables behind charts."""
