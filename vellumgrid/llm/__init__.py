"""Training-data operators: language id, licences, LM scoring, token files, BPE,
toxicity, decontamination, quality, exact search and near-duplicate removal.

Nothing outside this package imports it.  ``queries.py`` holds the thin contract
queries; every other module is an operator with its own general interface.
"""
