"""Scalar functions of the engine's dialect that Spark lacks or defines otherwise."""
