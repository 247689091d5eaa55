"""Extension: the same counts over streams of arriving files."""
