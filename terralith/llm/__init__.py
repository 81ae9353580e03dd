"""Training-data operators (optional subpackage; nothing else in the library imports it)."""
