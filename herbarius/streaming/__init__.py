"""Structured Streaming: landing that resumes where it stopped."""
