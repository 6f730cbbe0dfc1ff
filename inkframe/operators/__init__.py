"""Operators over boxes, labels, scores and feedback."""
