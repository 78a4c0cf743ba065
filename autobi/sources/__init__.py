"""Reading, typing and retention of tables."""
