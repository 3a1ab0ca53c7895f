"""Tablewright: conform dirty tabular data to relational targets, and prepare text corpora, on Spark."""
