"""Brindle: text, label and location analytics as Spark DataFrame operators."""
