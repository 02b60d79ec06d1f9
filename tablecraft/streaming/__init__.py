"""Fitted transforms on tables that keep growing."""
