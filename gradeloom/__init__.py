"""Gradeloom: assessment analytics expressed as Spark DataFrame operators."""
