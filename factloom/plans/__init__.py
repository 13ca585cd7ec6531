"""Registered queries: a name, the Spark plan and the SQL that must give the same rows."""
