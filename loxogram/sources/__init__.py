"""Readers, samplers, validators and writers."""
