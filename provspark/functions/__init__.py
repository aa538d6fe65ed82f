"""Scalar functions: canonical JSON, digests, fingerprints."""
