"""Record sources and sinks."""
