"""Sources and sinks of observations."""
