"""Named queries, the table views they read, and multi-step analyses."""
