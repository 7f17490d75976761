"""Scalar functions, each a builder of a native ``Column``."""
