"""Reading and writing: files, tables, reports, profile history and rule sets."""
