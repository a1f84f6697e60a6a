"""Training-data operators (packing, quality, dedup, language, decontamination ...).

Nothing else in the package imports this subpackage; it can be deleted as a whole.
"""
