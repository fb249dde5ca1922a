"""Reading and writing: files with declared schemas, JDBC, upserts, replacements, resuming."""
