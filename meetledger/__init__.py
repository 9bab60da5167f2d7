"""Booking-event analytics on Spark: from an event log to clean, current tables."""
