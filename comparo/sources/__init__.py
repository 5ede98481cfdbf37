"""Readers, writers and the driver-table stand-ins."""
