"""rippleframe: code-change impact analytics expressed as Spark DataFrames."""
