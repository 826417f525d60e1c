"""Whole plans and their settings."""
