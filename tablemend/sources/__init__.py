"""Reading observed tables and writing cleaned ones."""
