"""Operators over samples, readings and series frames."""
