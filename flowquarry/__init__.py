"""Labelled network-flow analytics as PySpark DataFrame operators."""
