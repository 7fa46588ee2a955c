"""Readers and writers for files, manifests, calibration data and reports."""
