"""Query catalogue: composed operators with their SQL counterparts."""
