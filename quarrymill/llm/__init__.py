"""Training-data operators (toxicity, secrets, near-duplicates, licences, media,
tokens, HTML, mixing, language, quality).  Nothing outside this package imports it."""
