"""Query catalogue: named plans with their SQL counterparts."""
