"""The row-local stages on a stream."""
