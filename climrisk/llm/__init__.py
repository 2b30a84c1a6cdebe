"""Training-data operators on text corpora; nothing else in the package imports them."""
