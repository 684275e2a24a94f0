"""Functions of the frame curation library."""
