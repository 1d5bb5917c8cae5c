"""Frame, segment and scorecard operators."""
