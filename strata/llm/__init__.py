"""Training-data operators: archives, de-duplication, decontamination, PII, classifiers, packing.

Nothing outside this subpackage imports it, except the guarded import in the
driver's entry module.
"""
