"""Evidence model, operands and driver-side plans."""
