"""Training-data operators: tokenizers, near duplicates, filters, language models, decontamination."""
