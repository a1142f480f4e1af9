"""Operators for training text. Nothing else in the package imports this subpackage."""
