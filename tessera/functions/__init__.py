"""Column functions and encoders."""
