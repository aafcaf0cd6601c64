"""Column functions: text, JSON, time, measures and question rules."""
