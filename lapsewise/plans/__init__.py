"""Queries, their SQL twins and the batch jobs, composed from the operators."""
