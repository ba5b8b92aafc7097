"""End-to-end plans composed of operators, and the registered queries."""
