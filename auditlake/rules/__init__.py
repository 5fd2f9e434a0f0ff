"""Rule texts, needle lists and control dimensions. Data only, no logic."""
