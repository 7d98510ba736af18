"""The log as a stream."""
