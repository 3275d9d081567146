"""Readers for labelled text and writers for results."""
