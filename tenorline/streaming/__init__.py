"""Session bars and cool-downs of unbounded series, by Structured Streaming."""
