"""Readers and parsers that turn raw inputs into typed rows."""
