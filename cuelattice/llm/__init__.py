"""Operators for large training collections; nothing outside this subpackage imports it."""
