"""Reading, writing and versioned publishing of tables."""
