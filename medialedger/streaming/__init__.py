"""Playback notifications as streams."""
