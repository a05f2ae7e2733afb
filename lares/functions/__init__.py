"""Column functions: arithmetic with defined edge cases, and the condition rules."""
