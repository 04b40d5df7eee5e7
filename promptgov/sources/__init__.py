"""Readers and writers: requests, policies, audit events."""
