"""Operators on DataFrames: joins, lists, filters, pages, reports and rules."""
