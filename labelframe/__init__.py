"""labelframe: labelled-record production, auditing and evaluation as DataFrame programs."""
