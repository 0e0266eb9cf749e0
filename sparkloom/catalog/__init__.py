"""Queries that apply the operators to the supplied tables, each with SQL for the same rows where SQL can say it."""
