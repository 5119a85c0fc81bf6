"""Operators for building language-model training sets; nothing else in the library imports this package."""
