"""Registered queries over the given tables, each with the SQL that checks it where SQL can."""
