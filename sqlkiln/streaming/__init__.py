"""Stateless prompt building on Structured Streaming sources."""
