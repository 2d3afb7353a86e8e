"""Streaming: the engine's capability target has none; its batch DataFrames can be used under Structured Streaming as they are."""
