"""Lexical analytics as Spark DataFrame plans."""
