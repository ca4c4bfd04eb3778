"""Table and message sources and sinks."""
