"""Requests over streams."""
