"""Training-data operators: filters, language, personal data, media, fingerprints, mixing, quality, tokens, chat."""
