"""Operators for training-data pipelines over crawled text."""
