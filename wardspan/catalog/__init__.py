"""Registered queries over the supplied tables, with SQL that computes the same results."""
