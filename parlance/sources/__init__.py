"""Table readers, adapters onto the catalog data model, and sinks."""
