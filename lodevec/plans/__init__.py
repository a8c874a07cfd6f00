"""Named queries of the core over the project's tables, with their SQL."""
