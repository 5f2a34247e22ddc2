"""Reading and writing tables: bound sources, slices, versions, sinks."""
