"""The composite queries a user calls."""
