"""Genomic interval and variant analytics as DataFrame expressions."""
