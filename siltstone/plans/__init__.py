"""Registered plans with their SQL."""
