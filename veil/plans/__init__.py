"""Policies and how they become one projection."""
