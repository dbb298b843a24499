"""Sources: messages, replay files, reference data, generated events."""
