"""Readers: whole reports become rows of the typed event table, bad ones rows of a reject table."""
