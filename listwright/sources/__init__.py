"""Feed readers, the versioned table store and the scoring config documents."""
