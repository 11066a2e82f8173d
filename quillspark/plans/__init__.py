"""Registered queries, see ``catalogue``."""
