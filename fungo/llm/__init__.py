"""Operators on text and vectors for training-data pipelines; nothing else imports them."""
