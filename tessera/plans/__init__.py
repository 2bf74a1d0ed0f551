"""Planning-time objects: extents, distributions, patterns and teams."""
