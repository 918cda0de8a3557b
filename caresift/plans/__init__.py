"""End-to-end flows made of operators."""
