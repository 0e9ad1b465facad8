"""Training-data operators over documents and pages."""
