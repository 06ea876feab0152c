"""The stream form of the operators."""
