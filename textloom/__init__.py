"""Text-quality and tabular analytics as DataFrame -> DataFrame operators."""
