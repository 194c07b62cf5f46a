"""Operators for preparing training texts; nothing else in the package imports them."""
