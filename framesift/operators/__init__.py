"""Operators of the frame curation library."""
