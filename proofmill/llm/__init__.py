"""Training-data operators: chat, deduplication, language, decontamination, mixing, output."""
