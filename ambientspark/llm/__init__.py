"""Operators for training-data pipelines over document tables; nothing else in the library imports them."""
