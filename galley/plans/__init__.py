"""Queries that put operators together."""
