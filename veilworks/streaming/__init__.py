"""The keyed state machines on streams."""
