"""Streaming of the frame curation library."""
