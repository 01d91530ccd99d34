"""Operators over whole datasets: detection, differential privacy, audit."""
