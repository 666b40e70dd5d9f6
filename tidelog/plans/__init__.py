"""plans of the observation engine."""
