"""Plans of the frame curation library."""
