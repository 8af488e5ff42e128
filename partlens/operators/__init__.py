"""DataFrame operators the built-in API does not spell directly."""
