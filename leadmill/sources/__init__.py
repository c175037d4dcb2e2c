"""Reading and writing tables and export files."""
