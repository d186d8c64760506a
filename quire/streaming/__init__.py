"""Structured Streaming over the stages that keep no state between documents."""
