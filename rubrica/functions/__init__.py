"""Column-level building blocks: text, rewards, judge text, display."""
