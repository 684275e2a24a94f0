"""Sources of the frame curation library."""
