"""Readers of server payloads and exports."""
