"""Queries over the driver's tables, and the SQL that they are held against."""
