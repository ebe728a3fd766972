"""End-to-end analyses: each module answers one question about a prepared corpus."""
