"""Training-data operators: near-duplicates, repeats, secrets, quality, HTML,
mixing, toxicity, decontamination, token counts and web archives.

Nothing outside this subpackage imports it.
"""
