"""Tables of observations, and readers and writers."""
