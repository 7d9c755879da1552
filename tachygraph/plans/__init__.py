"""Whole plans: recording to detections to metrics, and studies over trials."""
