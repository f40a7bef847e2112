"""Royalty, live-show and finance metrics as Spark jobs."""
