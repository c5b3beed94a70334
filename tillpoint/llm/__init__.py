"""Training-data operators: quality, search, toxicity, duplicates, language,
packing, language-model scoring and tokenization. Nothing else imports this."""
