"""Column typing rules and scalar expressions."""
