"""Fixture encoders; the engine's queries use them to make books of the driver's tables."""
