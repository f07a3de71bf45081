"""Helpers that shape physical execution: materialised stages, session setup."""
