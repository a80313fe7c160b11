"""Registered queries: each names a job on the tables and, where there is one, SQL that must give
the same rows."""
