"""Readers that turn raw payloads into rows, and keyed sinks."""
