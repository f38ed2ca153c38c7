"""Readers of landed files, versioned dimensions and writers with manifests."""
