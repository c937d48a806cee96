"""Structured Streaming form of the weekly rollup."""
