"""Curation of large collections of video-detection tables on Spark."""
