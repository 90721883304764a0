"""A PySpark engine for media catalogs and playback history."""
