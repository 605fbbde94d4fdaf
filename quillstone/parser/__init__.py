"""Rules text to typed abilities; pure Python, with Spark wrappers in parser.frames."""
