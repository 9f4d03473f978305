"""Operators for text corpora that become training data; nothing outside this folder uses them."""
