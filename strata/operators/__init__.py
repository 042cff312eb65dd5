"""DataFrame functions: joins, aggregates, windows, nested data, quality, changes, dimensions."""
