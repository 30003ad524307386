"""Sources and sinks of event and instance tables."""
