"""Training-data operators: packing, decontamination, language ID, dedup, WARC, LM scoring, token counts."""
