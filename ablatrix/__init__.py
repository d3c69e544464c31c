"""Ablatrix: intervention-sensitivity analytics as Spark DataFrame operators."""
