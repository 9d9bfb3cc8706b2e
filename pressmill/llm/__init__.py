"""Training-data operators: packing, toxicity, secrets, token files, language ID,
nearest neighbours, LM scoring, near-dedup, token counts, decontamination.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
