"""Pages, pictures and compact blocks."""
