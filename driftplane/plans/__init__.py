"""Whole queries: the session object and the command line."""
