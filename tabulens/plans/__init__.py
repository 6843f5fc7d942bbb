"""Declarative cleaning plans."""
