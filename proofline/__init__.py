"""Evidence, risk and assurance analytics expressed as Spark DataFrame operators."""
