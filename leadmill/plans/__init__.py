"""Loads and imports: several operators put together to produce new tables."""
