"""DataFrame operators over event and edge tables."""
