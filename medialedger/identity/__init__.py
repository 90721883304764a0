"""Identity resolution: connected components, duplicate groups and merges."""
