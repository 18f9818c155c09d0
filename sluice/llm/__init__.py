"""Training-data operators over document tables; self-contained."""
