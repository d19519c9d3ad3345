"""Operators for training-data corpora: search, tokenising, language, duplicates, leaks, toxicity, language models, licences.

Nothing else in the package imports this folder.  Shared conventions of all its operators:

* They name the columns they read and select only those, so further columns of any name do no harm.
* Rows whose id is null cannot be reported and take no part; null texts count as empty; an empty table gives an empty result.
* Several rows with one id are each reported.
"""
