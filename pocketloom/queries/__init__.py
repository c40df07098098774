"""Queries over the tables of a folder, one for each operator, and the SQL that gives the same rows."""
