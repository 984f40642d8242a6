"""Registered queries and the SQL that they agree with."""
