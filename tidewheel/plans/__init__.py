"""Queries composed of operators, with the SQL that each must match."""
