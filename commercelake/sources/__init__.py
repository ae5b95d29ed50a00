"""Table readers, entity views, snapshots and append-only sinks."""
