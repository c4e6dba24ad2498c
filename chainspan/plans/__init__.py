"""Rules and the plans that run them."""
