"""Sinks: HTML, workbook, JSON."""
