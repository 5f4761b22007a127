"""Parameterised DataFrame operators; every threshold is a keyword argument."""
