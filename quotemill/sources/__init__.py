"""Feeds, captures, snapshots and the test tape."""
