"""codeloom: code-intelligence and text analytics expressed as Spark DataFrame operators."""
