"""Bill-of-materials coverage analytics as Spark DataFrame operators."""
