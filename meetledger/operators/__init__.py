"""DataFrame-to-DataFrame operators over the event log."""
