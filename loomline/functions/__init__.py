"""Column expressions: tokens, kinds, templates, masks, regular expressions."""
