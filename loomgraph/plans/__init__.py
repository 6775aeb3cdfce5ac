"""Registered queries over the fixture tables and SQL that gives the same results."""
