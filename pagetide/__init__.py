"""Website-intelligence analytics as DataFrame operators."""
