"""Column functions: lexicon, text normalisation, matching and features."""
