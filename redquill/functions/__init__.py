"""Part of the redquill engine."""
