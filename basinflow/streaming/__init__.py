"""Incremental counting of transitions over a stream of frames."""
