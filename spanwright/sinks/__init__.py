"""Sinks: layouts, reviews, reports, and tables that are replaced as a whole."""
