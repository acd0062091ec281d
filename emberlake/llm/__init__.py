"""Operators that prepare a training corpus; nothing else in the package imports them."""
