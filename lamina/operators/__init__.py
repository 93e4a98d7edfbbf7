"""Dataflow operators over slices, hits and classes."""
