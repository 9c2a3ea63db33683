"""Queries that apply the operators to the tables of the star schema and of documents."""
