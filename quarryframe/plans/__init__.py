"""Pure-Python request planning; nothing here imports Spark."""
