"""The row-local rules on file streams."""
