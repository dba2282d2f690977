"""User-level products composed from the operators."""
