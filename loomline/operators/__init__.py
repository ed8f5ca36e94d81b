"""Table operators: counts, anchors, patterns, matching, the codec."""
