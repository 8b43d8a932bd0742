"""Structured Streaming over append-only tables: tails, windows over event time, and newest-wins state."""
