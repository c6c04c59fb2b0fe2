"""DataFrame to DataFrame operators and the small models they fit."""
