"""Training-data operators over text and embedding tables."""
