"""Policies and pipelines."""
