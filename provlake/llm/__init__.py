"""Operators for corpora that models are trained on."""
