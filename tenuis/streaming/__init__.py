"""No streaming operators: the work this engine covers is batch with a fixed cutoff date.

Late data are handled by the cutoff filter in ``tenuis.sources.quarantine``.
"""
