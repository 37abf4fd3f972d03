"""Operators: functions from DataFrames and parameters to a DataFrame."""

from millrace.operators import charts, columns, geo, grouping, joins, models, nested, ordered, quality, rows, scalars, scaling, statistics, tables, text  # noqa: F401
