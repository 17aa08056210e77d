"""The batch operators' counterparts on streams."""
