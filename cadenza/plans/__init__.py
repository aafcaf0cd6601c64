"""Batch compositions of the operators: whole lines of business."""
