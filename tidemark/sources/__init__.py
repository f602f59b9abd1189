"""Inputs: table views and file readers."""
