"""Change events and stateful admission."""
