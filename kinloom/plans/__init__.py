"""Choosing and running a matching plan."""
