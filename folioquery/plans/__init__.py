"""Expression dialects, their compiler to Columns, and query objects."""
