"""inkframe: glyph, expression and feedback analytics as Spark DataFrames."""
