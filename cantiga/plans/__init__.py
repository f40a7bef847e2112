"""Calls a user makes: metric queries, booking analyses, digests, question routing."""
