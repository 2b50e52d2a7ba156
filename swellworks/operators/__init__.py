"""Operators on bulletins, forecasts and stations."""
