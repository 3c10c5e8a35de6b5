"""The batch operators over streams of rows."""
