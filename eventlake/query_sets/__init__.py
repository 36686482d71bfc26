"""Named queries by subject; each module registers its own with their SQL."""
