"""Registered queries over the test tables, each with an independent SQL oracle."""
