"""The queries the engine is checked with, and the SQL they must agree with."""
