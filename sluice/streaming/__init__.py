"""Keyed state on streams: repeats, vote sessions, reputation."""
