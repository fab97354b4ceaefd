"""Spark-native evaluation of binary detectors on paired, labelled text."""

__version__ = "0.1.0"
