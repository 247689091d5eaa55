"""Column functions: text features, counters, money, media."""
