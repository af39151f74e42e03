"""Point sources and log sinks."""
