"""Session settings, table access, lineage cuts and salted lookups."""
