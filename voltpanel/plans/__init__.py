"""Plans: operators put together over concrete tables."""
