"""Reading files and pages, and telling what they are."""
