"""Composite entry points (analyzer bundles), the named query catalogue and
its independent SQL oracle."""
