"""Operators: each takes a DataFrame and returns a DataFrame, or a fitted transform of one."""
