"""Column functions: strategies, synthetic values, codecs, text finders, noise."""
